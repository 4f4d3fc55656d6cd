"""Quality rules as a short-circuit cascade.

A rule looks at a few features of a text and rejects it or not.  A text is kept if no rule rejects it, so the order of the
rules doesn't change verdicts; it changes what they cost.  The order is found on a bounded sample: the rule with the most rejections per second goes next, among the texts that
the rules before it let pass and with the features at hand that these have computed, so that a rule is charged only for what it adds.  Features are computed
when a rule first asks for them, and not at all if an earlier rule has rejected the text.  Features that the caller wants reported are computed for every text, and so cost no rule anything.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

SYMBOLS, SPACES = b"#*$%&|<>", " \t\n\x0b\x0c\r"
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """The number of words that stand in a window of so many words which is found twice or more in the text."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "int64", len(words))
    if len(ids) == len(words):
        return 0
    key, width = code[:n], len(ids)
    for k in range(1, window):  # exact: keys are numbered anew before they could overflow
        if width * len(ids) >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            width = len(seen)
        key, width = key * len(ids) + code[k : k + n], width * len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, "int64")
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


class Features(dict):
    """A text's features, computed when asked for."""

    def __init__(self, text: str):
        super().__init__()
        self.text, self.data = text, text.encode("utf-8", "replace")

    def copy(self) -> Features:
        """The same text with the features computed so far."""
        out = Features.__new__(Features)
        dict.__init__(out, self)
        out.text, out.data = self.text, self.data
        return out

    def __missing__(self, name: str):
        value = self[name] = getattr(self, "_" + name)()
        return value

    def _words(self):
        return self.data.split()

    def _n_words(self):
        return len(self["words"])

    def _word_chars(self):
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self):
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    def _n_dup_lines(self):
        lines = [x for x in self.data.split(b"\n") if x.strip()]
        self["n_lines"] = len(lines)
        return len(lines) - len(set(lines))

    def _n_lines(self):
        self["n_dup_lines"] = self._n_dup_lines()
        return dict.__getitem__(self, "n_lines")

    def _n_repeat_words(self):
        return repeated_words(self["words"])

    def _n_upper(self):
        return len(self.data) - len(self.data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def _n_lower(self):
        return len(self.data) - len(self.data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", lambda f: f["n_symbols"] > f["n_words"]),
    Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
    Rule("word_length", lambda f: not 2 * f["n_words"] <= f["word_chars"] <= 25 * f["n_words"]),
    Rule("shouting", lambda f: f["n_upper"] > f["n_lower"]),
)


def cascade(sample: list[str], rules: tuple[Rule, ...] = RULES, paid: tuple[str, ...] = ()) -> list[dict]:
    """The rules in the order to run them, with their marginal cost (seconds a text) and selectivity among the texts that reach them.  ``paid``: features computed anyway."""
    left, rest, out = [Features(t) for t in sample], list(rules), []
    for f in left:
        for name in paid:
            f[name]  # noqa: B018
    while rest:
        tried = []
        for r in rest:
            copies = [f.copy() for f in left]
            began = time.perf_counter()
            told = [r.rejects(f) for f in copies]
            cost = (time.perf_counter() - began) / max(1, len(left)) + 1e-9
            share = sum(told) / max(1, len(left))
            tried.append((share / cost, -cost, r, cost, share, copies, told))
        _, _, best, cost, share, copies, told = max(tried, key=lambda x: x[:2])
        out.append({"rule": best, "cost": cost, "selectivity": share})
        rest.remove(best)
        left = [f for f, t in zip(copies, told, strict=True) if not t]
    return out


def sample_texts(docs: DataFrame, text_col: str, id_col: str, rows: int, longest: int) -> list[str]:
    """About ``rows`` texts of up to ``longest`` characters, drawn by a hash of the id."""
    n = docs.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))
    return [r[0] for r in docs.where(draw & F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(text_col).limit(4 * rows).collect()]


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = REPORTED, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500, sample_longest: int = 20_000, trace: bool = False) -> DataFrame:
    """(id, the reported features, base_failed, kept) of every row.

    base_failed: a rule of BASE rejects the text; kept: no rule does.  Null texts count as empty (no words, so base_failed).  Ids may be null or
    repeated; other columns are ignored.  ``sample_rows`` and ``sample_longest`` bound the sample that orders the rules.  With ``trace``, two more columns: the names of the
    rules that were run, in order, the last one being the one that rejected the text if any did, and those of the features that were computed.  Without reported features, base_failed is null where a
    rule outside BASE has rejected the text before BASE was asked.
    """
    order = [x["rule"] for x in cascade(sample_texts(docs, text_col, id_col, sample_rows, sample_longest), rules, report)]
    base = {r.name for r in BASE}
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in report), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("rules_run", "features")] * trace]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for rows in pieces([(t,) for t in batch.column(1).to_pylist()], lambda r: r[0]):
                for (t,) in rows:
                    f = Features(t or "")
                    run_rules = []
                    failed = None
                    for r in order:
                        run_rules.append(r.name)
                        if r.rejects(f):
                            failed = r
                            break
                    fell = failed is not None
                    if fell and failed.name not in base:  # with the features of BASE reported, its rules cost nothing more
                        rest = [r for r in order if r.name in base and r.name not in run_rules]
                        fell = any(r.rejects(f) for r in rest) if report or not rest else None
                    got.append((*(f[c] for c in report), fell, failed is None, *[run_rules, sorted(f)][: 2 * trace]))
            kinds = [pa.int64()] * len(report) + [pa.bool_()] * 2 + [pa.list_(pa.string())] * (2 * trace)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=[x.name for x in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
