"""Personal data: four kinds found by their form, and more by bootstrapped contextual extraction; DataFrame operations only.

Seeds are the well-formed entities, and secrets: tokens that a key word and a sign of assignment introduce.  The words around an entity, lower-cased and with digits as wildcards, give its lexical patterns:
two words before it, two after it, one on either side, the first and third before it with any word between, and the single word before or after it, which needs more support.
Patterns and identifier-like tokens form a graph, which is scored in rounds until nothing changes: a pattern's precision for a kind is the share of its instances that are known to be of that
kind, and it is trusted with enough different known instances (``support``, or ``wide`` for patterns of one word) and a precision of ``trust``; an unknown token is accepted if the chance that all
its trusted patterns err is small enough, and counts as known in the next round.  So tokens are found whose own form says nothing, but which stand where
e-mail addresses or numbers do.  What has a kind's form and fails its check (a card number with a wrong last digit) is known to be nothing, and counts against its patterns.

Offsets come from splitting a text at its matches: a match starts where the pieces and matches before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_row_ids

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in their order: those of the contract, then secrets.
ALL = (*KINDS, "secret")
#: The contract's patterns, made linear on long runs: a match begins where a run begins or the last match ended, and nothing is tried twice.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What separates words and tokens.
APART = r"\s\x22'<>(),;"
#: Tokens that a pattern may discover: six characters or more that end in a letter or digit, with a digit or an at sign, or of letters with a dot or underscore between them.
TOKEN = rf"(?<![^{APART}])(?=[^{APART}]{{6}})(?=[^{APART}0-9@]*+[0-9@]|\p{{L}}++[._]\p{{L}})[^{APART}]*[\p{{L}}\p{{N}}]"
#: Words that introduce a secret; a token with a digit, of eight characters or more, that follows one of them and ``=`` or ``:`` is a seed.
SECRET = r"(?:^|[^a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key) ?[:=]+$"
DIGIT_OF = {"email": "@", "phone": "+"}
#: Characters of context on either side, and of a word of a pattern.
AROUND, WORD = 160, 40
#: ROUNDS only guards against endless runs: scoring ends when nothing changes, and fails if that takes more rounds.
SUPPORT, WIDE, TRUST, ACCEPT, ROUNDS = 3, 12, 0.8, 0.8, 1000


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text, "[0-9]+", "#"), f"[{APART}]+"), lambda w: w != ""), lambda w: F.substring(w, 1, WORD))


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a slot between words; those of a single word begin with ``1``."""
    l1, l2, l3 = (F.get(left, F.size(left) - k) for k in (1, 2, 3))
    r1, r2 = F.get(right, F.lit(0)), F.get(right, F.lit(1))
    blank = lambda *words: F.concat(*[x for w in words for x in (F.lit(" "), w if isinstance(w, Column) else F.lit(w))])  # null where a word is missing
    found = F.array(blank("2", l2, l1, "_"), blank("2", l3, "*", l1, "_"), blank("2", l1, "_", r1), blank("2", "_", r1, r2), blank("1", l1, "_"), blank("1", "_", r1))
    return F.array_compact(F.transform(found, lambda p: F.ltrim(p)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, kind, start, end, value, patterns): valid matches of each kind, secrets, tokens (kind ``token``) and what fails a kind's check (``none``), offsets in code points, end exclusive; a
    text without any has one row of nulls.  value is a hash; texts aren't carried along."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs, own = with_row_ids(docs.select(id_col, text_col), id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(own).alias("uid"), text.alias("t"))
    some = F.col("t").rlike("[0-9@]")
    found = []
    for kind, form in {**FORMS, "token": TOKEN}.items():
        has = F.contains("t", F.lit(DIGIT_OF[kind])) if kind in DIGIT_OF else some if kind in FORMS else some | F.col("t").rlike(r"\p{L}[._]\p{L}")
        parts = F.split("t", form, -1)
        matches = F.regexp_extract_all("t", F.lit(form), F.lit(0))
        # the text between matches, with the match before it and that after it, which belong to the context too
        items = F.arrays_zip(parts.alias("p"), F.concat(F.array(F.lit("")), matches).alias("a"), F.concat(matches, F.array(F.lit(None).cast("string"))).alias("b"))
        tail = lambda x: F.lower(F.substring(F.concat(x["a"], x["p"]), -AROUND, AROUND))
        head = lambda x: F.lower(F.substring(F.concat(x["p"], F.coalesce(x["b"], F.lit(""))), 1, AROUND))
        items = F.transform(items, lambda x: F.struct(F.length(x["p"]).alias("size"), tail(x).alias("tail"), head(x).alias("head"), x["b"].alias("match")))
        found.append(F.struct(F.lit(kind).alias("kind"), F.when(has, items).alias("hits")))
    rows = rows.select("doc_id", "uid", F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 1).alias("found"))
    rows = rows.select("doc_id", "uid", F.explode_outer("found").alias("f")).select("doc_id", "uid", "f.kind", F.posexplode_outer(F.arrays_zip(F.col("f.hits").alias("hit"), F.slice(F.col("f.hits.head"), F.lit(2), F.size("f.hits")).alias("after"))).alias("i", "x"))
    rows = rows.select("doc_id", "uid", "kind", "i", F.col("x.hit.size").alias("gap"), F.length("x.hit.match").alias("size"), F.col("x.hit.match").alias("match"), _words(F.col("x.hit.tail")).alias("left"), _words(F.col("x.after")).alias("right"))
    rows = rows.where("kind is null or match is not null")
    good = F.coalesce(_valid(F.col("kind"), F.col("match")), F.lit(False))
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    failed = ~good & ((F.col("kind") == "ip") | ((F.col("kind") == "card") & digits.between(13, 19)))
    said = F.concat_ws(" ", F.get("left", F.size("left") - 2), F.get("left", F.size("left") - 1))
    secret = (F.col("kind") == "token") & (F.length("match") >= 8) & F.col("match").rlike("[0-9]") & said.rlike(SECRET)
    kind = F.when(failed, "none").when(~good, F.lit(None)).when(secret, "secret").otherwise(F.col("kind"))
    rows = rows.select("uid", "doc_id", "kind", "i", "gap", "size", kind.alias("told"), F.xxhash64("match").alias("value"), F.when(kind.isNotNull(), _patterns(F.col("left"), F.col("right"))).alias("patterns")).repartition("uid")
    order = Window.partitionBy("uid", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    null = lambda c: F.when(F.col("told").isNotNull(), c)
    return rows.select("uid", "doc_id", F.col("told").alias("kind"), null(F.col("end") - F.col("size")).alias("start"), null(F.col("end")).alias("end"), null(F.col("value")).alias("value"), "patterns")


def discover(found: DataFrame, support: int = SUPPORT, wide: int = WIDE, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind) of the tokens that trusted patterns give a kind.

    ``found`` has a row (pattern, value, kind) for each pattern of each candidate.  Each round groups instances by pattern and by value (combined before the shuffle) and joins tables that have one
    row per pattern or value, so frequent patterns don't multiply rows.  Rounds go on until the learned rows are those of the round before.  Should
    they come back to those of an earlier round (values that change kind back and forth), values keep their kinds from then on, so that the rest settles.
    """
    marked = cut(found.where("pattern is not null").distinct())
    seeds = marked.where("kind not in ('token', 'none')").select("pattern", "value", F.col("kind").alias("known"))
    tokens = marked.where("kind = 'token'").select("pattern", "value")
    others = marked.where("kind = 'none'").select("pattern", "value")
    enough = F.col("n") >= F.when(F.col("pattern").startswith("1 "), max(wide, support)).otherwise(support)
    # without a pattern that has enough seeds, nothing can be trusted
    if seeds.groupBy("pattern", "known").agg(F.count(F.lit(1)).alias("n")).where(enough).isEmpty():
        return found.sparkSession.createDataFrame([], "value long, kind string")
    learned, last, seen, held = None, None, set(), False
    for _ in range(rounds):
        known = seeds if learned is None else seeds.unionByName(tokens.join(learned.withColumnRenamed("kind", "known"), "value").select("pattern", "value", "known")).distinct()
        mine = known.groupBy("pattern", "known").agg(F.count(F.lit(1)).alias("n"))
        # a token that holds a seed (as "<a@b.c>") is the same instance, so tokens only count where no seed starts there; see candidates_outside()
        every = known.select("pattern", "value").unionByName(tokens).unionByName(others).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
        trusted = mine.join(every, "pattern").withColumn("precision", F.col("n") / F.col("all")).where(enough & (F.col("precision") >= trust))
        err = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("precision")))))
        told = tokens.join(trusted.select("pattern", "known", "precision"), "pattern").groupBy("value", "known").agg((1 - err).alias("chance")).where(F.col("chance") >= accept)
        best = told.groupBy("value").agg(F.max_by("known", F.struct("chance", "known")).alias("kind"))
        if held:
            best = learned.unionByName(best.join(learned, "value", "left_anti"))
        learned = cut(best)
        now = tuple(learned.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("value", "kind"))).first())
        if now == last:
            return learned
        held = held or now in seen
        last = now
        seen.add(now)
    raise RuntimeError(f"personal data: patterns and tokens have not settled after {rounds} rounds")


def candidates_outside(found: DataFrame) -> DataFrame:
    """``found`` without the tokens that overlap a span of another kind: a sweep over each text's spans in order."""
    token = F.col("kind").isin("token", "secret")
    order = Window.partitionBy("uid").orderBy("start", token, "end")
    until = F.max(F.when(~token, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("uid").orderBy(F.desc("start"), token)
    following = F.min(F.when(~token, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    over = token & ((F.coalesce(until, F.lit(-1)) > F.col("start")) | (F.coalesce(following, F.lit(1 << 60)) < F.col("end")))
    same = F.max(F.when(~token, F.lit(1))).over(Window.partitionBy("uid", "start"))
    over = over | (token & same.isNotNull())
    return found.withColumn("over", F.coalesce(over, F.lit(False))).withColumn("kind", F.when(~F.col("over"), F.col("kind"))).drop("over")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_spans: bool = False, **limits) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row.

    The counts and the digest are of the well-formed entities; spans holds those and the discovered ones, as kind:start:end by kind as listed (secrets last), then
    start (with ``as_spans``, an array of structs), and n_spans is their number, so a row above 0 holds personal data of some kind.  Null counts as empty; a text without any span has the digest of the empty string.  Ids may be null or
    repeated: rows are told apart by their own number.  Other columns are ignored.
    """
    found = cut(candidates_outside(candidates(docs, id_col, text_col)))
    more = discover(found.select(F.explode("patterns").alias("pattern"), "value", "kind"), **limits)
    sure = found.where("kind = 'secret'").select("value", "kind").distinct()
    more = sure.unionByName(more.join(sure, "value", "left_anti"))
    rank = F.array_position(F.array(*map(F.lit, ALL)), F.col("kind"))
    tokens = found.where("kind in ('token', 'secret')").drop("kind").join(more, "value").select("uid", "doc_id", "kind", "start", "end", F.lit(False).alias("base"))
    base = found.select("uid", "doc_id", F.when(F.col("kind").isin(*KINDS), F.col("kind")).alias("kind"), "start", "end", F.lit(True).alias("base"))
    spans = base.unionByName(tokens).withColumn("span", F.when(F.col("kind").isNotNull(), F.struct(rank.alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "base")))
    out = spans.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("all"))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    own = F.filter("all", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(F.col("doc_id").alias(id_col), *map(count, KINDS), F.sha2(text(own), 256).alias("base_sha256"), (F.col("all") if as_spans else text("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
