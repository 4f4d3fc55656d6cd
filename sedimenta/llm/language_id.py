"""Language identification with interpolated Kneser-Ney character models.

Each language has its own model of orders 1 to ``order`` over the characters of words (runs of letters, lower-cased, with a
start and an end mark; letters a-z next to digits, as in hexadecimal numbers and codes, are no words unless a text has no others), learned from a bounded sample of labelled rows.  A model is a few sorted arrays: the hashes of its
n-grams with their interpolated log-probabilities, and the hashes of its contexts with their back-off weights.  A text gets the
language of the lowest cross-entropy per character.  Because no context crosses a word's start, a text's score is the sum of its
words' scores, and workers remember words.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, narrow, pieces

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W_]+")
UNDETERMINED = "und"
ALPHABET = 5000
MIX = 0x9E3779B97F4A7C15
#: Remembered words, and of these times languages; characters that are scored together, times languages.
WORDS, CELLS, BLOCK = 200_000, 20_000_000, 1 << 27


def words_of(text: str) -> list[str]:
    """Words of a text; codes of ASCII letters and digits say nothing of its language, and only count where there is nothing else."""
    text = text.lower()
    found = TOKEN.findall(text)
    words = [t for t in found if t.isalpha()]
    if len(words) < len(found):
        words += [w for t in found if not t.isalpha() and not t.isascii() for w in WORD.findall(t)]
    return words or WORD.findall(text)


def _hashes(codes, order: int):
    """For each n from 1 to order, the hash of the n characters that end at each position, from a matrix of shifted codes."""
    import numpy as np

    out = []
    for n in range(1, order + 1):
        h = np.full(codes.shape[1], n, "uint64")
        for k in range(n - 1, -1, -1):
            h = (h ^ codes[k]) * np.uint64(MIX)
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _positions(words: list[str]):
    """Codes of '^word$' for all words in one row, shifted: row k holds the character k places earlier (0 before a word's start mark).

    Returned with the word's index of each position that is predicted (all but start marks), and the number of characters before it.
    """
    import numpy as np

    joined = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), "u4").astype("uint64")
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
    return joined, word, at


def _shifted(joined, at, order: int):
    import numpy as np

    codes = np.zeros((order, len(joined)), "uint64")
    for k in range(order):
        codes[k, k:] = joined[: len(joined) - k] if k else joined
        codes[k][at < k] = 0
    return codes


class KneserNey:
    """One language's model."""

    def __init__(self, counts: Counter, order: int):
        """counts: of words."""
        import numpy as np

        self.order = order
        words = list(counts)
        joined, word, at = _positions(words)
        weight = np.array([counts[w] for w in words], "float64")[word]
        codes = _shifted(joined, at, order)
        keep = at > 0
        hashes = _hashes(codes, order)
        contexts = [np.zeros(len(joined), "uint64"), *hashes[:-1]]  # of the position before
        contexts = [c if n == 0 else np.concatenate([[np.uint64(0)], c[:-1]]) for n, c in enumerate(contexts)]
        self.grams, self.backs = [], []
        lower = None
        for n in range(1, order + 1):
            use = keep & (at >= n - 1)
            full = n == order
            h, first, inv = np.unique(hashes[n - 1][use], return_index=True, return_inverse=True)
            if full:
                count = np.bincount(inv, weight[use])
            else:  # continuation counts; n-grams at a word's start have no left extension and keep their own count
                wider = hashes[n][use]
                begins = at[use] == n - 1
                pair = np.unique(np.stack([inv[~begins].astype("uint64"), wider[~begins]]), axis=1)[0].astype("int64") if (~begins).any() else np.zeros(0, "int64")
                count = np.bincount(pair, minlength=len(h)).astype("float64")
                own = np.bincount(inv[begins], weight[use][begins], minlength=len(h))
                count = np.where(own > 0, own, count)
            ctx = contexts[n - 1][use][first]
            ch, cinv = np.unique(ctx, return_inverse=True)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = np.bincount(cinv, count), np.bincount(cinv)
            back = discount * kinds / total
            if n == 1:
                below = np.full(len(h), 1.0 / ALPHABET)
            else:
                below = np.exp(lower[use][first])
            p = np.maximum(count - discount, 0) / total[cinv] + back[cinv] * below
            logp = np.log(p)
            self.grams.append((h, logp.astype("float32")))
            self.backs.append((ch, np.log(back).astype("float32")))
            here = np.full(len(joined), np.log(1.0 / ALPHABET))
            here[use] = logp[inv]
            if n > 1:
                short = keep & ~use
                here[short] = lower[short]
            lower = here

    def score(self, hashes, contexts, at):
        """Log-probabilities of the given positions, from the longest order down."""
        import numpy as np

        out = np.zeros(len(at))
        left = np.arange(len(at))
        for n in range(self.order, 0, -1):
            fit = at[left] >= n - 1
            h, logp = self.grams[n - 1]
            here = left[fit]
            if len(h) and len(here):
                q = hashes[n - 1][here]
                i = np.minimum(np.searchsorted(h, q), len(h) - 1)
                hit = h[i] == q
                out[here[hit]] += logp[i[hit]]
                miss = here[~hit]
                ch, back = self.backs[n - 1]
                q = contexts[n - 1][miss]
                i = np.minimum(np.searchsorted(ch, q), len(ch) - 1)
                seen = ch[i] == q
                out[miss[seen]] += back[i[seen]]
                left = np.concatenate([left[~fit], miss])
        out[left] += np.log(1.0 / ALPHABET)
        return out


class LanguageModels:
    """All languages' models, with what calibration found: a temperature for scores, and the limits of rejection."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4):
        self.languages, self.order = sorted(texts), order
        self.models, held = [], []
        for lang in self.languages:
            rows = texts[lang]
            test = rows[::8] if len(rows) >= 16 else []
            held += [(lang, t) for t in test]
            counts = Counter()
            for i, t in enumerate(rows):
                if not test or i % 8:
                    counts.update(words_of(t))
            self.models.append(KneserNey(counts or Counter({"": 1}), order))
        self._start()
        self.center, self.spread, self.limit = {lang: 3.0 for lang in self.languages}, dict.fromkeys(self.languages, 2.0), dict.fromkeys(self.languages, 12.0)
        self.temperature = 20.0
        self._calibrate(held)

    def _start(self):
        self.known, self.table, self.used = {}, None, 0
        self.most = max(1000, min(WORDS, CELLS // (len(self.languages) + 1)))

    def forget(self):
        """Drops the remembered words."""
        self.known, self.table, self.used = {}, None, 0

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None, "used": 0}

    def word_scores(self, words: list[str]):
        """A row for each word: its log-probability under each language, then its number of predicted characters."""
        import numpy as np

        joined, word, at = _positions(words)
        codes = _shifted(joined, at, self.order)
        hashes = _hashes(codes, self.order)
        contexts = [np.zeros(len(joined), "uint64")] + [np.concatenate([[np.uint64(0)], h[:-1]]) for h in hashes[:-1]]
        use = np.flatnonzero(at > 0)
        hashes, contexts, at, word = [h[use] for h in hashes], [c[use] for c in contexts], at[use], word[use]
        out = np.zeros((len(words), len(self.languages) + 1))
        for k, m in enumerate(self.models):
            out[:, k] = np.bincount(word, m.score(hashes, contexts, at), minlength=len(words))
        out[:, -1] = np.bincount(word, minlength=len(words))
        out[[not any(map(str.isalpha, w)) for w in words]] = 0
        return out

    def block(self) -> int:
        """Characters to score together: fewer with many languages, as each word has a number for each."""
        return max(20_000, min(1 << 20, BLOCK // (len(self.languages) + 1)))

    def totals(self, texts: list[str]):
        """Sums of word_scores over each text."""
        import numpy as np

        listed = [words_of(t) for t in texts]
        known = self.known
        new = list({w for ws in listed for w in ws if w not in known})
        if len(known) + len(new) > self.most:
            known.clear()
            self.used, new = 0, list({w for ws in listed for w in ws})
        need = self.used + len(new)
        if self.table is None or need > len(self.table):
            bigger = np.zeros((max(need, 2 * self.most if self.table is None else 2 * len(self.table)), len(self.languages) + 1))
            if self.used:
                bigger[: self.used] = self.table[: self.used]
            self.table = bigger
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.table[self.used : self.used + len(part)] = self.word_scores(part)
            known.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        at = known.__getitem__
        return np.array([self.table[list(map(at, ws))].sum(0) if ws else np.zeros(len(self.languages) + 1) for ws in listed]).reshape(len(texts), -1)

    def _calibrate(self, held):
        import numpy as np

        if not held:
            return
        sums = np.concatenate([self.totals([t for _, t in part]) for part in pieces(held, lambda r: r[1], self.block())])
        chars, truth = sums[:, -1], np.array([self.languages.index(lang) for lang, _ in held])
        ok = chars > 0
        if not ok.any():
            return
        rate, truth, chars = sums[ok, :-1] / chars[ok, None], truth[ok], chars[ok]
        best = None
        for temp in (1, 2, 5, 10, 20, 50, 100):
            x = rate * temp
            x -= x.max(1, keepdims=True)
            loss = -(x[np.arange(len(x)), truth] - np.log(np.exp(x).sum(1))).mean()
            if best is None or loss < best - 1e-6:
                best, self.temperature = loss, float(temp)
        own = rate.argmax(1) == truth  # rows that another language fits better are mislabelled or mixed, and say nothing of their label's limit
        if not own.any():
            return
        entropy, truth, chars = -rate[np.arange(len(rate)), truth][own], truth[own], chars[own]
        self.center, self.spread, self.limit, bare = {}, {}, {}, []
        for k, lang in enumerate(self.languages):
            own = truth == k
            if not own.any():
                bare.append(lang)
                continue
            mid = float(np.median(entropy[own]))
            z = (entropy[own] - mid) * np.sqrt(chars[own])
            self.center[lang], self.spread[lang] = mid, max(float(np.median(np.abs(z))) * 1.4826, 0.5)
            # a few rows of languages without a model may bear the label: the largest values don't count, and "lower" leaves one out of few rows too
            self.limit[lang] = 3.0 * max(3.0, float(np.quantile(z, 0.95, method="lower")) / self.spread[lang])
        loosest = max(self.limit.values())
        for lang in bare:  # nothing is known of these, so they reject least
            self.center[lang], self.spread[lang], self.limit[lang] = float(np.median(entropy)), 2.9652, loosest

    def predict(self, texts: list[str]):
        """(language, score, cross-entropy, rejected) of each text."""
        import numpy as np

        out = []
        for row in self.totals(texts):
            n = row[-1]
            if not n or not self.languages:
                out.append((UNDETERMINED, 0.0, None, True))
                continue
            rate = row[:-1] / n
            k = int(np.argmax(rate))
            lang, x = self.languages[k], np.exp((rate - rate[k]) * self.temperature)
            over = -rate[k] - self.center[lang]
            out.append((lang, float(1.0 / x.sum()), float(-rate[k]), bool(over > max(0.7, self.limit[lang] * self.spread[lang] / np.sqrt(n)))))
        return out


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows whose crc32(id as text) mod 5 is not 0 (a null id counts as ''), with a language and a text."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), fold.alias("fold")).where("fold <> 0 and l is not null and t is not null")


def learn(docs: DataFrame, rows_per_language: int = 1500, rows_in_all: int = 60_000, longest: int = 20_000, order: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars_in_all: int = 40_000_000) -> LanguageModels:
    """Models of all labels, learned from a sample: at most ``rows_per_language`` rows of each language, ``rows_in_all`` in all and
    ``chars_in_all`` characters, but one row at least of each label.  Rows are drawn by a hash of id and text, rows alike in both count once, and of those drawn the smallest hashes come first, so the
    bounds hold whatever the table's size and ids.  Of a text above ``longest`` characters it takes a stretch of so many, whose place the hash chooses.
    """
    rows = training_rows(docs, id_col, text_col, lang_col)
    size = F.least(F.length("t"), F.lit(longest))
    counts = {r["l"]: (r["n"], r["chars"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars")).collect()}
    if not counts:
        return LanguageModels({}, order)
    each, chars = max(1, min(rows_per_language, rows_in_all // len(counts))), chars_in_all / len(counts)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n, chars / max(1, c))) for lang, (n, c) in counts.items()], "l string, share double")
    key = F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit("")), "t")
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    start = F.pmod(key, F.length("t") - longest + 1).cast("int") + 1
    stretch = F.when(F.length("t") > longest, F.substring(F.col("t"), start, F.lit(longest))).otherwise(F.col("t")).alias("t")
    texts: dict[str, list[str]] = {}
    taken = dict.fromkeys(counts, 0)
    rows = rows.join(narrow(shares, len(counts)), "l").withColumn("draw", draw)
    for r in rows.where("draw < share").select("l", "draw", stretch).distinct().orderBy("draw", "l", "t").toLocalIterator():
        mine = texts.setdefault(r["l"], [])
        if not mine or len(mine) < each and taken[r["l"]] + len(r["t"]) <= chars:
            mine.append(r["t"])
            taken[r["l"]] += len(r["t"])
    missed = [(lang,) for lang in counts if lang not in texts]
    if missed:  # none of their rows was drawn
        rest = rows.join(narrow(docs.sparkSession.createDataFrame(missed, "l string"), len(missed)), "l").select("l", stretch, F.struct("draw", F.xxhash64("t").alias("h")).alias("by"))
        for r in rest.groupBy("l").agg(F.min_by("t", "by").alias("t")).toLocalIterator():
            texts[r["l"]] = [r["t"]]
    return LanguageModels({k: sorted(v) for k, v in texts.items()}, order)


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", add: tuple[str, str, str, str] = ("lang_pred", "score", "cross_entropy", "rejected")) -> DataFrame:
    """``docs`` with four more columns: the language of the lowest cross-entropy, its share after calibration (0 to 1), that cross-entropy per
    character, and whether it is too high for the language (or there is no letter, and so no language: ``und``, score 0).

    Null and empty texts have no letter.  Equal cross-entropies go to the first language in alphabetical order.  A column of ``docs``
    that has an added column's name is replaced.
    """
    docs = docs.drop(*add)
    schema = T.StructType([*docs.schema.fields, T.StructField(add[0], T.StringType()), T.StructField(add[1], T.DoubleType()), T.StructField(add[2], T.DoubleType()), T.StructField(add[3], T.BooleanType())])
    shared, at = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text_col)

    def rows(m, batches):
        import pyarrow as pa

        for batch in batches:
            got = [x for part in pieces([(t,) for t in batch.column(at).to_pylist()], lambda r: r[0], m.block()) for x in m.predict([r[0] or "" for r in part])]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *add])

    def run(batches):
        m = shared.value
        try:
            yield from rows(m, batches)
        finally:  # the worker stays for other stages
            m.forget()
            give_back()

    return docs.mapInArrow(run, schema)
