"""Saved sessions: the inputs, plot settings, grey ramp and view of a plot as TOML.  Sequences are not part of it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..operators.kernel import Scoring
from ..plans.dotplot import PlotConfig

VERSION = 2
# Sections of a session file with their fields in order, and the defaults of fields that older files lack.
FIELDS = {
    "plot": ("mode", "matrix_name", "window_size", "zoom", "pixel_fac", "strand", "self_comparison", "triangle", "memory_limit_mib"),
    "greyramp": ("white", "black", "swap"),
    "view": ("offset_x", "offset_y", "display_zoom", "crosshair", "light_theme", "align_dock_visible", "align_window_size"),
}
DEFAULTS = {"align_dock_visible": True, "align_window_size": 100}
OPTIONAL = {"window_size", "crosshair"}


class SessionError(ValueError):
    """A session file that can't be used."""


@dataclass(frozen=True)
class Session:
    plot: dict
    greyramp: dict
    view: dict
    query: str | None = None
    subject: str | None = None
    version: int = VERSION


def _value(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(_value, x)) + "]"
    if isinstance(x, int | float):
        return repr(x)
    escaped = "".join({"\\": "\\\\", '"': '\\"'}.get(c, c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}") for c in str(x))
    return f'"{escaped}"'


def session_toml(session: Session) -> str:
    """The session's file; fields without a value are left out."""
    line = lambda k, v: "" if v is None else f"{k} = {_value(v)}\n"
    head = line("version", session.version) + line("query", session.query) + line("subject", session.subject)
    return head + "".join(f"\n[{part}]\n" + "".join(line(f, getattr(session, part).get(f)) for f in fields) for part, fields in FIELDS.items())


def parse_session(text: str) -> Session:
    """A session of any version up to the present one.

    Before version 2 the crosshair counted pixels: it becomes the residue in the middle of its block.
    """
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SessionError(f"not a session file: {e}") from e
    version = raw.get("version")
    if not isinstance(version, int) or version > VERSION:
        raise SessionError(f"session version {version} is not known; this reads up to {VERSION}")
    parts = {}
    for part, fields in FIELDS.items():
        have = DEFAULTS | raw.get(part, {})
        if lost := [f for f in fields if f not in have and f not in OPTIONAL]:
            raise SessionError(f"[{part}] lacks {', '.join(lost)}")
        parts[part] = {f: have[f] for f in fields if f in have}
    if version < 2 and (at := parts["view"].get("crosshair")):
        zoom = max(1, parts["plot"]["zoom"])
        parts["view"]["crosshair"] = [int(p) * zoom + zoom // 2 for p in at]
    return Session(query=raw.get("query"), subject=raw.get("subject"), version=VERSION, **parts)


def read_session(spark: SparkSession, path: str) -> Session:
    """A session from any store that Spark reads (one small file)."""
    return parse_session(spark.read.text(path, wholetext=True).first()["value"])


def plot_config(session: Session, scoring: Scoring | None = None) -> PlotConfig:
    """The session's plot settings; ``scoring`` is looked up by the caller for matrices other than DNA identity."""
    p = session.plot
    cfg = PlotConfig(zoom=p["zoom"], factor=p["pixel_fac"], strand=p["strand"], self_plot=p["self_comparison"], triangle=p["triangle"], memory_limit=p["memory_limit_mib"] << 20)
    if scoring is not None:
        cfg = replace(cfg, scoring=scoring)
    return replace(cfg, window=p["window_size"]) if p.get("window_size") else cfg
