"""Column functions over DNA and protein strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "ACGTN"
PROTEIN = "ARNDCQEGHILKMFPSTWYVBZX*"
# Fixed value: the standard genetic code, codons in the order T, C, A, G.
CODONS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_ASCII = "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _ASCII, _ASCII.upper())


def dna_view(text: Column) -> Column:
    """The ACGT letters of a text, upper case."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def protein_view(text: Column) -> Column:
    """The ASCII letters of a text, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))


def encode_letter(letter: Column, alphabet: str) -> Column:
    """Index of a letter in the alphabet, in either case; null for any other."""
    at = F.instr(F.lit(alphabet), ascii_upper(letter))
    return F.when((F.length(letter) == 1) & (at > 0), at - 1)


def encode_string(s: Column, alphabet: str) -> Column:
    """Array of letter indices (null for letters outside the alphabet)."""
    letters = F.filter(F.split(ascii_upper(s), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.nullif(F.instr(F.lit(alphabet), c) - 1, F.lit(-1)))


def letter_count(s: Column, letters: str) -> Column:
    """How many characters of ``s`` are among ``letters``; no explode."""
    return F.length(s) - F.length(F.translate(s, letters, ""))


def complement(s: Column) -> Column:
    """A-T and C-G exchanged, in upper case; anything else becomes N."""
    return F.translate(F.regexp_replace(ascii_upper(s), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def complement_code(code: Column) -> Column:
    return F.when(code < 4, 3 - code).otherwise(code)


#: All codons in the order of ``CODONS``, four characters each.
_CODON_LIST = "".join(f"{a}{b}{c} " for a in "TCAG" for b in "TCAG" for c in "TCAG")


def _amino_acid(codon: Column) -> Column:
    at = F.instr(F.lit(_CODON_LIST), codon)
    return F.when((at > 0) & (F.length(codon) == 3), F.substr(F.lit(CODONS), F.shiftright(at - 1, 2) + 1, F.lit(1))).otherwise("X")


def translate_codon(codon: Column) -> Column:
    """One amino acid: U reads as T, a stop is ``*``, any unknown base gives X."""
    return _amino_acid(F.translate(ascii_upper(codon), "U ", "T."))


def translate_frame(s: Column, frame: int) -> Column:
    """The codons from ``frame`` (0 to 2) on as a protein string; empty if too short or beyond 2."""
    if frame > 2:
        return F.lit("")
    letters = F.translate(ascii_upper(s), "U ", "T.")
    codons = F.regexp_extract_all(F.substring(letters, frame + 1, 2**31 - 1), F.lit("(?s).{3}"), 0)
    return F.array_join(F.transform(codons, _amino_acid), "")


def detect_alphabet(s: Column) -> Column:
    """Protein if over a tenth of the first 4096 characters are letters outside ACGTNU; Unknown if empty."""
    sample = F.substring(s, 1, 4096)
    odd = F.length(F.regexp_replace(sample, "[^A-Za-z]|[ACGTNUacgtnu]", ""))
    return F.when(F.length(sample) == 0, "Unknown").when(odd * 10 > F.length(sample), "Protein").otherwise("Dna")


def mode_for(alphabet: Column, mode: Column) -> Column:
    """The mode after a look at the letters: protein input leaves DNA mode, DNA input leaves protein modes."""
    return F.when((alphabet == "Protein") & (mode == "blastn"), "blastp").when((alphabet == "Dna") & (mode != "blastn"), "blastn").otherwise(mode)


def slice_pair(q: Column, s: Column, q_at: Column, s_at: Column, flank: int) -> Column:
    """Equally long excerpts around a crosshair: struct (q_lo, s_lo, length, q_text, s_text)."""
    q_lo, s_lo = F.greatest(F.lit(0), q_at - flank), F.greatest(F.lit(0), s_at - flank)
    q_n = F.least(q_at + (flank + 1), F.length(q)) - q_lo
    s_n = F.least(s_at + (flank + 1), F.length(s)) - s_lo
    n = F.greatest(F.lit(0), F.least(q_n, s_n))
    return F.struct(q_lo.alias("q_lo"), s_lo.alias("s_lo"), n.alias("length"), F.substr(q, (q_lo + 1).cast("int"), n.cast("int")).alias("q_text"), F.substr(s, (s_lo + 1).cast("int"), n.cast("int")).alias("s_text"))


def match_line(q: Column, s: Column) -> Column:
    """``|`` where equal, a blank elsewhere."""
    pairs = F.zip_with(F.split(q, ""), F.split(s, ""), lambda a, b: F.when((a == b) & (a != ""), "|").otherwise(" "))
    return F.array_join(pairs, "")


def _letter(text: Column, pos: Column) -> Column:
    """The letter at a 0-based place; null outside."""
    return F.when((pos >= 0) & (pos < F.length(text)), F.substr(text, (pos + 1).cast("int"), F.lit(1)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _excerpt(text: Column, mid: Column, window: int) -> Column:
    """struct (text, mid): the letters around a place, so that reading one doesn't walk the whole text; places outside the text stay outside."""
    low = F.greatest(F.lit(0), mid - window).cast("int")
    near = F.when(mid.isNotNull(), F.substr(text, low + 1, F.greatest(F.lit(0), mid + (window + 1) - low).cast("int")))
    return F.struct(near.alias("text"), (mid - low).alias("mid"))


def window_score(q: Column, s: Column, q_mid: Column, s_mid: Column, window: int, scoring, strand: str = "forward") -> Column:
    """Score of the window around a place of a plot; letters outside the sequences or the alphabet score 0.

    The reverse strand reads the subject backwards and complemented; ``both`` takes the larger one.
    """
    half = window // 2

    def total(reverse: bool) -> Column:
        def step(acc, k):
            a = _letter(q, q_mid - half + k)
            b = _letter(s, s_mid + half - k if reverse else s_mid - half + k)
            b = complement(b) if reverse else b
            return acc + F.coalesce(scoring.column(encode_letter(a, scoring.alphabet), encode_letter(b, scoring.alphabet)), F.lit(0)).cast("long")

        return F.aggregate(F.sequence(F.lit(0), F.lit(window - 1)), F.lit(0).cast("long"), step)

    if strand == "both" and len(scoring.alphabet) == 4:
        return F.greatest(total(False), total(True))
    return total(strand == "reverse" and len(scoring.alphabet) == 4)


def alignment_columns(q: Column, s: Column, q_mid: Column, s_mid: Column, window: int, scoring=None, reverse: bool = False) -> Column:
    """Array of struct (q, s, class, score) around a crosshair, which is column ``window div 2``.

    Classes: OutOfBounds beyond a sequence (shown as ``-``), Identical for equal letters, Positive for a
    score above 0, Other.  ``reverse`` walks the subject backwards and complemented.
    """
    half = window // 2

    def cell(k, near):
        q, q_mid, s, s_mid = near["q"]["text"], near["q"]["mid"], near["s"]["text"], near["s"]["mid"]
        off = k - half
        a, raw = _letter(q, q_mid + off), _letter(s, s_mid - off if reverse else s_mid + off)
        code = lambda c: (F.lit(None).cast("int") if scoring is None else encode_letter(c, scoring.alphabet))
        pair = F.struct(a.alias("a"), (complement(raw) if reverse else raw).alias("b"))
        return _let(pair, lambda x: _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), code(x["a"]).alias("i"), code(x["b"]).alias("j")), shown))

    def shown(x):
        a, b = x["a"], x["b"]
        out = a.isNull() | b.isNull()
        score = F.lit(0) if scoring is None else F.coalesce(scoring.column(x["i"], x["j"]), F.lit(0))
        same = (ascii_upper(a) == ascii_upper(b)) & a.rlike("^[A-Za-z]$")
        kind = F.when(out, "OutOfBounds").when(same, "Identical").when(score > 0, "Positive").otherwise("Other")
        return F.struct(F.coalesce(a, F.lit("-")).alias("q"), F.coalesce(b, F.lit("-")).alias("s"), kind.alias("class"), F.when(out, 0).otherwise(score).cast("int").alias("score"))

    both = F.struct(_excerpt(q, q_mid, window).alias("q"), _excerpt(s, s_mid, window).alias("s"))
    return _let(both, lambda near: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: cell(k, near)))


def clipboard_text(q: Column, s: Column, q_mid: Column, s_mid: Column, window: int, scoring, both: bool = False) -> Column:
    """The alignment around a crosshair as text: the place, then a block of three lines for the forward strand and, with ``both``, one for the reverse strand.

    Letters outside a sequence are ``-``, those that can't be printed ``?``; the line between shows ``|`` for
    equal letters and ``:`` for other positive scores; ends are 1-based and may lie outside.
    """
    half = window // 2
    line = lambda name, first, text, last: F.concat(F.format_string(f"{name:<9}5' %8d ", first), text, F.lit(" "), F.rpad(last.cast("string"), 8, " "), F.lit(" 3'\n"))

    def block(reverse: bool) -> Column:
        s0, s1 = (s_mid + (half + 1), s_mid + (half - window + 2)) if reverse else (s_mid - (half - 1), s_mid - (half - window))

        def lines(cells: Column) -> Column:
            shown = lambda c: F.array_join(F.transform(cells, lambda x: F.when(x[c].rlike("^[!-~]$"), x[c]).otherwise("?")), "")
            marks = F.array_join(F.transform(cells, lambda x: F.when(x["class"] == "Identical", "|").when(x["class"] == "Positive", ":").otherwise(" ")), "")
            return F.concat(line("query", q_mid - (half - 1), shown("q"), q_mid - (half - window)), F.lit(" " * 20), marks, F.lit("\n"), line("subject", s0, shown("s"), s1))

        return _let(alignment_columns(q, s, q_mid, s_mid, window, scoring, reverse), lines)

    head = F.concat(F.format_string(f"q = %d   s = %d   window = {window}\n\n+/+\n", q_mid + 1, s_mid + 1), block(False))
    return F.concat(head, F.lit("\n+/-\n"), block(True)) if both else head


def zoom_period_hints(q_hint: Column, s_hint: Column, self_plot: bool) -> Column:
    """Periods that a zoom should divide: a self plot's own hint, or both hints if there are two."""
    if self_plot:
        return F.array_compact(F.array(q_hint))
    return F.when(q_hint.isNotNull() & s_hint.isNotNull(), F.array(q_hint, s_hint)).otherwise(F.array().cast("array<long>"))
