"""Score matrices: a built-in one, a parser for the public text format, checks and a writer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.sequence import PROTEIN
from .operators.kernel import Scoring

# BLOSUM62, the public NCBI table of 24 letters in its text format.
BLOSUM62 = """
   A  R  N  D  C  Q  E  G  H  I  L  K  M  F  P  S  T  W  Y  V  B  Z  X  *
A  4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
R -1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
N -2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
D -2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
C  0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
Q -1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
E -1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
G  0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
H -2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
* -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""

#: Matrices by name; all but BLOSUM62 are read from files in the public text format.
NAMES = ("BLOSUM45", "BLOSUM50", "BLOSUM62", "BLOSUM80", "BLOSUM90", "PAM30", "PAM70", "PAM250")


@dataclass(frozen=True)
class ScoreMatrix:
    name: str
    alphabet: str
    rows: tuple[tuple[int, ...], ...]

    def scoring(self) -> Scoring:
        return Scoring(self.alphabet, table=self.rows)

    def lowest(self) -> int:
        return min(map(min, self.rows))

    def highest(self) -> int:
        return max(map(max, self.rows))

    def validate(self) -> ScoreMatrix:
        n = len(self.alphabet)
        if len(self.rows) != n or any(len(r) != n for r in self.rows):
            raise ValueError(f"{self.name}: {n} x {n} scores are needed")
        if self.lowest() >= 0 or self.highest() <= 0:
            raise ValueError(f"{self.name}: scores of both signs are needed")
        return self

    def to_text(self) -> str:
        """The public text format; ``parse_matrix`` reads it back."""
        lines = ["# " + self.name, "   " + "  ".join(self.alphabet)]
        return "\n".join(lines + [c + " " + " ".join(f"{x:2d}" for x in r) for c, r in zip(self.alphabet, self.rows, strict=True)]) + "\n"

    def frame(self, spark: SparkSession) -> DataFrame:
        """``matrix, row, col, score``."""
        return spark.createDataFrame([(self.name, i, j, x) for i, r in enumerate(self.rows) for j, x in enumerate(r)], "matrix string, row int, col int, score int")


def custom_dna(match: int, mismatch: int, name: str = "custom") -> ScoreMatrix:
    return ScoreMatrix(name, "ACGT", tuple(tuple(match if i == j else mismatch for j in range(4)) for i in range(4)))


def dna_identity() -> ScoreMatrix:
    return custom_dna(5, -4, "DNA+5/-4")


def blosum62() -> ScoreMatrix:
    """BLOSUM62 over 24 letters."""
    return parse_matrix(BLOSUM62, "BLOSUM62")


def parse_matrix(text: str, name: str, alphabet: str = PROTEIN, extra_letters: str = "J") -> ScoreMatrix:
    """Parse the public text format: ``#`` comments, a header of letters, one row for each letter in any order.

    Letters outside ``alphabet`` must be among ``extra_letters``; every cell of the alphabet is required.
    """
    lines = [ln.split() for ln in text.splitlines() if ln.strip() and not ln.lstrip().startswith("#")]
    if not lines:
        raise ValueError(f"{name}: no header")
    header, cells = [c.upper() for c in lines[0]], {}
    for c in header:
        if len(c) != 1 or c not in alphabet + extra_letters:
            raise ValueError(f"{name}: unknown letter {c!r}")
    for row in lines[1:]:
        letter, scores = row[0].upper(), row[1:]
        if letter not in alphabet + extra_letters:
            raise ValueError(f"{name}: unknown letter {letter!r}")
        if len(scores) != len(header):
            raise ValueError(f"{name}: row {letter} has {len(scores)} scores, the header {len(header)} letters")
        cells |= {(letter, c): int(x) for c, x in zip(header, scores, strict=True)}
    missing = [(a, b) for a in alphabet for b in alphabet if (a, b) not in cells]
    if missing:
        raise ValueError(f"{name}: no score for {missing[0]}")
    return ScoreMatrix(name, alphabet, tuple(tuple(cells[a, b] for b in alphabet) for a in alphabet)).validate()


def matrix_from_file(path: str, name: str, alphabet: str = PROTEIN) -> ScoreMatrix:
    """A matrix of the BLOSUM or PAM family from a file in the public text format."""
    with open(path, encoding="ascii") as f:
        return parse_matrix(f.read(), name, alphabet)


def by_name(name: str, folder: str | None = None) -> ScoreMatrix:
    """A matrix of ``NAMES`` in any case; those that are not built in are files of that name in ``folder``."""
    known = {n.lower(): n for n in NAMES}.get(name.lower())
    if known is None:
        raise ValueError(f"unknown matrix {name!r}; known are {', '.join(NAMES)}")
    if known == "BLOSUM62":
        return blosum62()
    if folder is None:
        raise ValueError(f"{known} is read from a folder of matrix files; none was given")
    return matrix_from_file(f"{folder}/{known}", known)


def by_mode(mode: str) -> ScoreMatrix:
    return dna_identity() if mode == "blastn" else blosum62()
