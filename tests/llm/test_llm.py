"""Training-data operators against brute force, and on odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from sedimenta.llm import common, encoding, exact_dedup, language_id, license_scan, mixing, personal_data, quality_rules, queries, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "uid string, label string, kind string, value long, row_id int, mix_cdf string, mix_source string, score int, gid int, digit int, copy int, span int, fp int, component_id int, rejected int"
LONG = "a long word " * 20_000
ODD = ["", None, "x", "one two three", "equal text here to stay", "equal text here to stay", LONG, LONG, "\n\n \t", "ünï cödé 漢字 🎉 K", "the " * 12, "no-digits@all", "1234", "  two  spaces ", "naïve façade", "Under the MIT\nLicense", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(ODD)]
    rows += [(None, "null id", None, None, None), (3, "one two three", "de", "s", 1), (3, "another text, same id", "de", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in CLASH.split(", ")))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -5")


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf, odd, none):
    for docs in (documents(spark, sf), odd):
        texts = Counter((r["doc_id"], brute_quality(r["text"])) for r in docs.collect())
        got = rows(quality_rules.apply_rules(docs))
        assert Counter((r["doc_id"], tuple(r[c] for c in quality_rules.REPORTED)) for r in got) == texts
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert not rows(quality_rules.apply_rules(none))


def test_cascade_orders_by_rejection_per_cost():
    def slow(f):
        hashlib.pbkdf2_hmac("sha1", b"x", b"y", 3000)
        return len(f.text) > 5

    rules = (quality_rules.Rule("slow", slow), quality_rules.Rule("never", lambda f: False), quality_rules.Rule("fast", lambda f: len(f.text) > 3))
    order = quality_rules.cascade(["abcd", "abcdefg", "a"] * 5, rules)
    assert order[0]["rule"].name == "fast" and order[0]["selectivity"] == pytest.approx(2 / 3)
    assert {x["rule"].name: x["selectivity"] for x in order[1:]} == {"slow": 0, "never": 0}


def test_rules_are_charged_for_what_they_add():
    """Two rules share a slow feature: once one of them has run, or where the feature is reported, the other is cheap."""
    class Slow(quality_rules.Features):
        def _n_words(self):
            hashlib.pbkdf2_hmac("sha1", b"x", b"y", 5000)
            return len(self.text)

    quality = quality_rules.Rule
    rules = (quality("a", lambda f: f["n_words"] > 6), quality("b", lambda f: f["n_words"] > 7))
    import unittest.mock

    with unittest.mock.patch.object(quality_rules, "Features", Slow):
        order = quality_rules.cascade(["x" * k for k in range(4, 9)] * 4, rules)
        assert order[0]["cost"] > 20 * order[1]["cost"]
        assert all(x["cost"] < 1e-3 for x in quality_rules.cascade(["x" * k for k in range(4, 9)] * 4, rules, ("n_words",)))


def test_rejected_texts_skip_rules(spark, sf):
    docs = documents(spark, sf)
    full = {r["doc_id"]: r["kept"] for r in rows(quality_rules.apply_rules(docs))}
    got = rows(quality_rules.apply_rules(docs, report=(), trace=True))
    assert {r["doc_id"]: r["kept"] for r in got} == full and not all(full.values())
    every = {x.name for x in quality_rules.RULES}
    assert all(set(r["rules_run"]) == every for r in got if r["kept"])
    short = [r for r in got if not r["kept"] and len(r["rules_run"]) < len(every)]
    assert short and any(len(r["features"]) < max(len(x["features"]) for x in got) for r in short)


def test_repeated_words_many_distinct():
    words = [b"%d" % i for i in range(9000)] + [b"%d" % i for i in range(50, 57)]
    assert quality_rules.repeated_words(words) == 14


# mixing


def test_mixing(spark, sf, odd, none):
    docs = documents(spark, sf)
    equal = rows(mixing.mix_sources(docs, weights={"src0": 1.0, "src1": 3.0}).groupBy("source").count())
    n = {r["source"]: r["count"] for r in equal}
    assert set(n) == {"src0", "src1"} and n["src1"] > 1.5 * n["src0"]
    got = rows(mixing.mix_sources(odd))
    assert all(0 <= r["copy"] < r["n_copies"] for r in got)
    again = rows(mixing.mix_sources(odd.repartition(3)))
    key = lambda r: (r["doc_id"], r["text"], r["source"], r["copy"], r["n_copies"], r["shuffle_key"])
    assert Counter(map(key, got)) == Counter(map(key, again)) and got
    assert got[0].keys() == again[0].keys() == {*odd.columns, "copy", "n_copies", "shuffle_key"}
    assert not rows(mixing.mix_sources(none))
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, weights={"nowhere": 1.0})


def test_mixing_is_poisson(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) as source")
    got = mixing.mix_sources(docs, power=0.0).groupBy("source", "doc_id").count().groupBy("source").agg({"count": "sum", "doc_id": "count"})
    n = {r["source"]: (r["sum(count)"], r["count(doc_id)"]) for r in got.collect()}
    assert all(abs(total - 4000) < 300 for total, _ in n.values())
    hot = 20_000 / 3
    assert abs(n["hot"][1] - hot * (1 - 2.718281828 ** -(4000 / hot))) < 250
    high = mixing.mix_sources(docs.limit(3), weights={"hot": 1.0, "s1": 0.0}, power=0).count()
    assert high < 30


def test_large_rates(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id = 0, 'rare', 'common') as source")
    n = mixing.mix_sources(docs, weights={"rare": 1.0, "common": 1.0}).where("source = 'rare'").count()
    assert 1300 < n < 1700


def test_rates_without_bound(spark):
    """High rates in parts: tables of chances stay short, and counts are Poisson numbers of the whole rate."""
    docs = spark.createDataFrame([(0, "rare"), (1, "rare")], "doc_id long, source string").unionByName(spark.range(2, 4000).selectExpr("id as doc_id", "'common' as source"))
    rate, _, _ = mixing.rates(docs, "source", {"rare": 500.0, "common": 1e-3}, 0)
    assert max(len(r["mix_cdf"]) for r in rate.collect()) < 200
    n = mixing.mix_sources(docs, weights={"rare": 500.0, "common": 1e-3}).where("source = 'rare'").groupBy("doc_id").count().collect()
    assert len(n) == 2 and all(abs(r["count"] - 2000) < 250 for r in n)
    one = spark.range(1).selectExpr("id as doc_id", "'rare' as source").unionByName(spark.range(1, 500).selectExpr("id as doc_id", "'other' as source"))
    assert abs(mixing.mix_sources(one, weights={"rare": 1.0}).count() - 500) < 120


def test_hot_sources_beyond_broadcasts(spark, monkeypatch):
    docs = spark.range(600).selectExpr("if(id < 200, null, id) as doc_id", "id as n", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('s', id) end as source", "concat('t', id) as text")
    key = lambda r: (r["doc_id"], r["n"], r["source"], r["copy"], r["n_copies"], r["shuffle_key"])
    want = Counter(map(key, rows(mixing.mix_sources(docs))))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
    got = mixing.mix_sources(docs)
    assert Counter(map(key, rows(got))) == want and want


# exact dedup


def brute_exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    return out


def test_exact_dedup(spark, sf, odd, none):
    docs = documents(spark, sf)
    for d, widths in ((docs, {}), (odd, {}), (docs, {"first_width": 1, "growth": 8, "widest": 4096}), (docs.unionByName(docs), {})):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact_dedup.exact_dedup(d, **widths)))
        assert got == brute_exact((r["doc_id"], r["text"]) for r in d.collect())
    assert not rows(exact_dedup.exact_dedup(none))
    assert exact_dedup.drop_exact_copies(odd).columns == odd.columns
    left = rows(exact_dedup.drop_exact_copies(odd))
    assert Counter(r["text"] or "" for r in left) == Counter({t or "": 1 for t in [*ODD, "null id", "another text, same id"]})
    assert {r["doc_id"] for r in rows(exact_dedup.drop_exact_copies(docs))} == {i for i, k, _, kept, _ in brute_exact((r["doc_id"], r["text"]) for r in docs.collect()) if kept}


def test_exact_dedup_beyond_broadcasts(spark, odd, monkeypatch):
    """Hot groups of every kind where next to nothing may be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    texts = ["same text " * 30] * 40 + ["same text " * 30 + "but another end"] * 20 + [f"same text {i}" for i in range(20)] + ["", None] * 5
    hot = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (hot, odd.unionByName(odd)):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact_dedup.exact_dedup(docs, first_width=16, growth=4)))
        assert got == brute_exact((r["doc_id"], r["text"]) for r in docs.collect())
        assert len(rows(exact_dedup.drop_exact_copies(docs))) == docs.selectExpr("coalesce(text, '')").distinct().count()


# licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, sf, odd, none):
    extra = spark.createDataFrame([(0, "x Under THE mit-License under the mit license; CC by nc by nc cc by nc"), (1, "APACHE license, version 2.0 and cc-by-nc"), (2, "under the mit Kicense")], "doc_id long, text string")
    for docs in (documents(spark, sf), odd, extra):
        got = rows(license_scan.scan_licenses(docs))
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r["doc_id"], *brute_licenses(r["text"])) for r in docs.collect())
        assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert not rows(license_scan.scan_licenses(none))


def test_license_passages_with_edits(spark):
    mit = re.findall(license_scan.WORD, license_scan.TEMPLATES[0][0].lower())
    edited = [*mit[:6], "very", *mit[6:]]
    docs = spark.createDataFrame([(0, "words before " + " ".join(mit)), (1, " ".join(edited)), (2, " ".join(mit[:8])), (3, " ".join(reversed(mit)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(license_scan.scan_licenses(docs, spans=True))}
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1 and (got[0]["spans"][0]["first"], got[0]["spans"][0]["last"]) == (2, len(mit) + 1)
    assert got[1]["labels"] == "mit" and got[1]["score"] < 1 and got[1]["base_labels"] == ""
    assert got[2]["labels"] == got[3]["labels"] == ""


def test_one_changed_word_keeps_the_label(spark):
    texts, want = ["This work is licensed under the Creative Commons Attribution-ShareAlike"], ["cc-by-sa"]
    for text, label in license_scan.TEMPLATES:
        words = re.findall(license_scan.WORD, text.lower())
        for at in (0, len(words) // 2):
            texts.append(" ".join([*words[:at], "otherwise", *words[at + 1 :]]))
            want.append(label)
        texts.append(text)
        want.append(label)
    got = {r["doc_id"]: r["labels"] for r in rows(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert all(label in got[i].split(",") for i, label in enumerate(want)), [(texts[i], got[i], x) for i, x in enumerate(want) if x not in got[i].split(",")]
    assert all(got[i] == label for i, label in enumerate(want) if i and i % 3 == 0)


def test_whole_licenses_in_other_text(spark):
    """Recall and precision over whole licenses with words changed, put in and left out (three in a hundred), set between other words; and ordinary text with their vocabulary."""
    r = random.Random(2)
    stock = [w for text, _ in license_scan.TEMPLATES for w in re.findall(license_scan.WORD, text.lower())]
    filler = lambda n: " ".join(r.choice(stock) for _ in range(n))
    docs, want = [], []
    for text, label in license_scan.TEMPLATES:
        for _ in range(3):
            words = re.findall(license_scan.WORD, text.lower())
            if len(words) < 24:
                continue
            out = []
            for w in words:
                x = r.random()
                out += [] if x < 0.01 else [w, "indeed"] if x < 0.02 else ["otherwise"] if x < 0.03 else [w]
            docs.append(f"{filler(40)} {' '.join(out)} {filler(40)}")
            want.append(label)
    clean = [filler(200) for _ in range(40)]
    got = {x["doc_id"]: x["labels"] for x in rows(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(docs + clean)), "doc_id long, text string")))}
    assert sum(label in got[i].split(",") for i, label in enumerate(want)) >= 0.9 * len(want)
    assert not any(got[len(docs) + i] for i in range(len(clean)))


# personal data


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(text):
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    counts, spans = [], []
    for kind, (form, ok) in forms.items():
        hits = [m for m in re.finditer(form, text or "") if ok(m[0])]
        counts.append(len(hits))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in hits]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), ",".join(spans)


HARD = ["a@b.c_x@y.z.q 1.2.3.45.6.7.8", "🎉🎉 x@y.zz", "é+1 (017) 555-7713 4111 1111 1111 1111 00004111111111111111", "a@b@c.d ++1234567890- +1 2", "999.1.1.1 1.1.1.1.1.1.1.1", "4111-1111-1111-1111 4111  1111", "x@" + "a." * 3000 + "b", "1" * 5000, "a" * 5_000 + "@", "@a.b .@-.-"]


def test_personal_data(spark, sf, odd, none):
    r = random.Random(5)
    noise = ["".join(r.choice("ab1234567890@.+- ()é") for _ in range(r.randint(1, 80))) for _ in range(400)]
    hard = spark.createDataFrame(list(enumerate(HARD + noise)), "doc_id long, text string")
    for docs in (documents(spark, sf), odd, hard):
        got = rows(personal_data.find_personal_data(docs))
        want = Counter((x["doc_id"], *brute_personal(x["text"])[0]) for x in docs.collect())
        assert Counter((x["doc_id"], x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"]) for x in got) == want
        assert all(x["n_spans"] == len(x["spans"].split(",")) * (x["spans"] != "") >= x["n_email"] + x["n_ip"] + x["n_card"] + x["n_phone"] for x in got)
    assert not rows(personal_data.find_personal_data(none))
    assert [x["spans"] for x in sorted(rows(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"))), key=lambda x: x["doc_id"])] == [brute_personal(t)[1] for t in HARD]


def test_bootstrapped_patterns(spark):
    known = [(i, f"Please write to user{i}@mail.example.org about it") for i in range(6)]
    fresh = [(10, "please write to jane4.at.example about it"), (11, "the year 2024abcd was fine"), (12, "Ask, or please  write to: bob7(at)example")]
    got = {r["doc_id"]: r["spans"] for r in rows(personal_data.find_personal_data(spark.createDataFrame(known + fresh, "doc_id long, text string")))}
    assert got[10] == "email:16:32" and got[11] == "" and got[0] == "email:16:38"


def test_patterns_in_a_chain(spark):
    """Seeds -> 'write to' -> a tokens -> 'reach me' -> b -> 'ask for' -> c -> 'call on' -> d: four hops."""
    texts = [f"write to user{i}@mail.example.org" for i in range(625)] + [f"write to a{i}.at.host" for i in range(125)]
    texts += [f"reach me a{i}.at.host" for i in range(125)] + [f"reach me b{i}.at.host" for i in range(25)]
    texts += [f"ask for b{i}.at.host" for i in range(25)] + [f"ask for c{i}.at.host" for i in range(5)]
    texts += [f"call on c{i}.at.host" for i in range(5)] + ["call on d0.at.host"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(personal_data.find_personal_data(docs))}
    assert got == {i: f"email:{t.rindex(' ') + 1}:{len(t)}" for i, t in enumerate(texts)}
    with pytest.raises(RuntimeError):
        personal_data.find_personal_data(docs, rounds=3)


def test_planted_identifiers_are_found(spark):
    """Recall and precision on planted identifiers without a form, in varied contexts among ordinary text, and on decoys in other places."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    filler = lambda n: " ".join(word() for _ in range(n))
    frames = {
        "email": ["please contact {} for details", "mail sent to {} yesterday", "author: {} (maintainer)", "you can reach {} any time"],
        "ip": ["login from {} port 22", "host address {} is down", "blocked by peer {} again"],
        "phone": ["call me at {} after work", "tel. number {} ext", "fax line {} works"],
        "card": ["charged to card {} on", "visa ending {} expired"],
    }
    def card():
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    good = {"email": lambda: f"{word()}{r.randint(1, 99)}@{word()}.org", "ip": lambda: ".".join(str(r.randint(1, 250)) for _ in range(4)), "phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", "card": card}
    odd_one = {"email": lambda: r.choice([f"{word()}{r.randint(1, 99)}.at.{word()}", f"{word()}_dot_{word()}_at_{word()}x"]), "ip": lambda: "fe80::" + "".join(r.choice("0123456789abcdef") for _ in range(4)) + f":{r.randint(10, 99)}", "phone": lambda: f"{r.randint(100, 999)}/{r.randint(100, 999)}.{r.randint(100, 999)}", "card": lambda: f"4x{r.randint(10**5, 10**6)}xx{r.randint(10, 99)}"}
    docs, want = [], {}
    for kind, texts in frames.items():
        for frame in texts:
            for make, n in ((good[kind], 30), (odd_one[kind], 5)):
                for _ in range(n):
                    value, lead = make(), filler(r.randint(3, 30)) + " "
                    docs.append(lead + frame.format(value) + " " + filler(10))
                    at = len(lead) + frame.index("{}")
                    want[len(docs) - 1] = f"{kind}:{at}:{at + len(value)}"
    for _ in range(300):  # decoys: codes, dates, versions, and numbers that fail a check
        x = r.choice([f"{word()}{r.randint(1, 99)}x", f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"v{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}", card()[:-1] + "x", f"300.{r.randint(1, 9)}.1.1"])
        docs.append(f"{filler(r.randint(3, 20))} {x} {filler(5)}")
    docs += [f'{filler(5)} api_key = "{"".join(r.choice("0123456789abcdef") for _ in range(32))}" {filler(3)}' for _ in range(5)]
    docs.append('so the TOKEN: "abcdefgh12" it is')
    got = {x["doc_id"]: x["spans"] for x in rows(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")))}
    hit = [i for i, span in want.items() if span in got[i].split(",")]
    formless = [i for i in want if brute_personal(docs[i])[1] == ""]
    assert len(formless) >= 50 and sum(i in hit for i in formless) >= 0.9 * len(formless) and all(got[i] == span for i, span in want.items() if i in hit)
    assert all(got[i] == brute_personal(docs[i])[1] for i in range(len(want), len(want) + 300))
    assert all(got[len(docs) - k].startswith("secret:") for k in range(1, 7))


def test_failed_checks_count_against_patterns(spark):
    texts = [f"paid with {c} today" for c in ("4111111111111111", "5500005555555559", "4012888888881881")] + [f"paid with 411111111111111{k} today" for k in (2, 3, 4)] + ["paid with number77x today"]
    got = {x["doc_id"]: x["spans"] for x in rows(personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [bool(got[i]) for i in range(7)] == [True] * 3 + [False] * 4


def test_a_token_of_two_kinds_settles(spark):
    """Equally good kinds give one of them, and others still get theirs."""
    found = [("p", k, "email") for k in range(8)] + [("q", 100 + k, "phone") for k in range(8)]
    found += [("p", 50, "token"), ("q", 50, "token"), ("p", 51, "token")]
    found = spark.createDataFrame(found, "pattern string, value long, kind string")
    got = {r["value"]: r["kind"] for r in personal_data.discover(found).collect()}
    assert set(got) == {50, 51} and got[51] == "email"


# near duplicates


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    pairs = list(pairs)
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        least[root(i)].append(d)
    return Counter((d, f"{f:016x}", min(x for x in least[root(i)] if x is not None)) for i, (d, f) in enumerate(pairs))


def test_simhash(spark, sf, odd, none):
    near = spark.createDataFrame([(100 + i, "same words again and again " * 40 + ("tail" * (i % 3))) for i in range(12)], "doc_id long, text string")
    for docs in (documents(spark, sf), odd.where("doc_id is not null"), near):
        got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(docs)))
        assert got == brute_components((r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect())
    assert not rows(simhash.near_duplicates(none))
    assert len(rows(simhash.near_duplicates(odd))) == odd.count()
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


def test_near_duplicates_go_by_row(spark):
    """A row goes only if its own group has another that stays, whatever its id."""
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "wholly different words in this one here"), (1, "a b c d e"), (None, "a b c d e"), (None, "one more text of its own kind again")], "doc_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in rows(simhash.drop_near_duplicates(docs)))
    assert left == Counter([(1, "a b c d e"), (3, "wholly different words in this one here"), (None, "one more text of its own kind again")])
    twice = docs.unionByName(docs)
    assert Counter((r["doc_id"], r["text"]) for r in rows(simhash.drop_near_duplicates(twice))) == left


def test_simhash_beyond_broadcasts(spark, monkeypatch):
    """One large group of copies and a hub, where nothing may be broadcast, and shards that are dealt to several tasks."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash, "FULL", 7)
    docs = spark.createDataFrame([(i, "same words again and again " * 40 + ("tail" * (i % 3) if i % 2 else "")) for i in range(60)] + [(100 + i, f"text {i} of its own {i * i}") for i in range(40)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(docs)))
    assert got == brute_components((r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect())
    assert {r["doc_id"] for r in rows(simhash.drop_near_duplicates(docs))} == {c for _, _, c in got}


def test_depth_follows_the_input():
    assert [simhash.tree_depth(n) for n in (0, 2048, 2049, 250_000, 10**6, 10**7, 10**8, 10**9, 10**12)] == [0, 0, 1, 7, 7, 8, 11, 14, 16]


@pytest.mark.parametrize("leaf", [2048, 16])
def test_vantage_trees_miss_no_link(spark, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "INNER", leaf)
    monkeypatch.setattr(simhash, "FULL", 100 if leaf == 16 else simhash.FULL)
    r = random.Random(leaf)
    centers = [r.getrandbits(64) for _ in range(150)]
    fps = set(centers)
    for c in centers:
        for _ in range(r.randint(0, 6)):
            x = c
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {centers[0] ^ (i << 7) for i in range(64)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.components(simhash.fingerprint_links(distinct, len(signed))).collect()
    label = {x["node"]: x["label"] for x in got}
    want = brute_components([(f, f & (1 << 64) - 1) for f in signed])
    assert Counter((f, f"{f & (1 << 64) - 1:016x}", label.get(f, f)) for f in signed) == want


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)], "a long, b long")
    label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    assert label == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}


# archives


def test_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    long = "<p>" + "z" * 300
    more = [(1000, "http://a b/\n", long), (900, None, long), (901, "u", "short"), (902, "u", "short"), (903, "u", None), (904, None, ""), (None, "n", long), (905, "http://ü/", "é" * 50), (906, "x", "é" * 50), (900, "again", long), (907, "big", "q" * 3_000_000)]
    docs = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).selectExpr("*", "1 as digest", "2 as kind", "3 as shard", "4 as refers_to")
    folder = "file://" + str(tmp_path / "a")
    manifest = warc.write_archives(docs, folder, roll=20_000, shard=60_000).collect()
    got = warc.read_archives(spark, folder).collect()
    assert all(r["digest_ok"] for r in got) and sum(m["records"] for m in manifest) == len(got) == docs.count()
    first = {}
    for r in docs.collect():
        t = (r["html"] or "").encode()
        if r["page_id"] is not None:
            first[t] = min(first.get(t, r["page_id"]), r["page_id"])
    want = Counter()
    for r in docs.collect():
        t = (r["html"] or "").encode()
        to = first[t] if len(t) >= 100 and r["page_id"] is not None and r["page_id"] > first[t] else None
        want[(r["page_id"], len(t), hashlib.sha256(t).hexdigest(), "response" if to is None else "revisit", to, t if to is None else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["html"] is None else bytes(r["html"])) for r in got) == want
    assert len(manifest) > 5 and not [x for x in (tmp_path / "a").iterdir() if x.name.endswith(".tmp")]
    again = "file://" + str(tmp_path / "b")
    warc.write_archives(docs.repartition(7), again, roll=20_000, shard=60_000)
    names = sorted(x.name for x in (tmp_path / "a").iterdir() if x.name.endswith(".gz"))
    assert names == sorted(x.name for x in (tmp_path / "b").iterdir() if x.name.endswith(".gz"))
    assert all((tmp_path / "a" / x).read_bytes() == (tmp_path / "b" / x).read_bytes() for x in names)
    assert not rows(warc.round_trip(docs.where("page_id < -1")))


def test_damaged_payloads_are_noticed(spark, tmp_path, monkeypatch):
    import gzip

    pages = spark.createDataFrame([(1, "u", "<p>first page</p>" * 20), (2, "v", "<p>second page</p>" * 20)], "page_id long, url string, html string")
    folder, write = "file://" + str(tmp_path / "a"), warc.write_archives

    def damage(*args, **options):
        out = write(*args, **options)
        for file in (tmp_path / "a").glob("*.gz"):
            with open(file, "rb") as f:
                records = list(warc.members(f))
            file.write_bytes(b"".join(gzip.compress(r.replace(b"second page", b"another one", 1)) for r in records))
        return out

    monkeypatch.setattr(warc, "write_archives", damage)
    with pytest.raises(Exception, match="not that of its digest: page 2"):
        warc.round_trip(pages, folder).collect()
    texts = {1: b"<p>first page</p>" * 20, 2: (b"<p>second page</p>" * 20).replace(b"second page", b"another one", 1)}
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"], r["digest_ok"]) for i, r in got.items()} == {i: (len(t), hashlib.sha256(t).hexdigest(), i == 1) for i, t in texts.items()}


def test_shard_bounds(spark):
    """Shards of equal size whatever the ids: dense and sparse ranges, null and repeated ids, and rows alike in everything."""
    ids = [*range(100), 10**12, *[None] * 50, *[7] * 50]
    sizes = spark.createDataFrame([(i, k, 10) for k, i in enumerate(ids)] + [(8, 5, 10)] * 60, "page_id long, tie long, bytes long")
    for d in (sizes, sizes.repartition(5)):
        bounds = warc.shard_bounds(d, target=100)
        got = Counter()
        place = warc.Placement(bounds)
        keys = [(r["page_id"], r["tie"]) for r in sizes.collect()]
        got.update(place.shards([k[0] for k in keys], [k[1] for k in keys], list(range(len(keys)))).tolist())
        assert bounds == sorted(bounds) and len(bounds) == 26 and set(got) <= set(range(27)) and len(got) >= 25 and max(got.values()) <= 20


def test_urls_come_back(spark, tmp_path):
    urls = ["http://a/%41?b=%25", "http://a/\u2028x", "http://a b/\r\nX: y", "http://ü/漢", "", None, "%", "\u00a0\t"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = "file://" + str(tmp_path / "a")
    warc.write_archives(pages, folder)
    assert {r["page_id"]: r["url"] for r in warc.read_archives(spark, folder).collect()} == dict(enumerate(urls))
    assert b"%E2%80%A8" in warc.make_record(1, "http://a/\u2028x", b"", "d", None) and b"WARC-Target-URI: http://a/%41?b=%25\r" in warc.make_record(1, urls[0], b"", "d", None)


def test_null_ids_span_shards(spark, tmp_path):
    pages = spark.createDataFrame([(None, f"u{i}", f"<p>{i}" * 100) for i in range(60)] + [(5, "same", "<b>" * 200)] * 60, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, "file://" + str(tmp_path / "a"), shard=10_000).collect()
    assert len(manifest) >= 8 and sum(m["records"] for m in manifest) == 120 and max(m["records"] for m in manifest) < 40
    assert {r["record_type"] for r in warc.read_archives(spark, "file://" + str(tmp_path / "a")).collect()} == {"response"}


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_encoding_equals_the_library(spark, sf, odd, none, library):
    for docs in (documents(spark, sf), odd):
        want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in docs.collect())
        got = rows(encoding.encode_pieces(docs, queries.model_path()))
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
        counts = rows(encoding.token_counts(docs, queries.model_path(), budget=100))
        assert Counter((r["doc_id"], r["n_tokens"], r["over_limit"]) for r in counts) == Counter((i, len(ids), len(ids) > 100) for (i, ids), n in want.items() for _ in range(n))
    assert not rows(encoding.encode_pieces(none, queries.model_path())) and not rows(encoding.token_counts(none, queries.model_path()))


def test_decoding(spark, odd):
    got = {r["doc_id"]: r["text"] for r in rows(encoding.decode_pieces(encoding.encode_pieces(odd.where("doc_id > 3"), queries.model_path()), queries.model_path()))}
    assert got == {i: t or "" for i, t in enumerate(ODD) if i > 3}


def test_prefix_counts(library):
    m = encoding.transducer(queries.model_path())
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice("aehntr  iosd.,T1\n éü一▁-🎉") for _ in range(r.randint(0, 40)))
        assert m.encode(t) == library.encode(t)
        counts = m.prefix_counts(t).tolist()
        assert counts == [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        for budget in range(10):
            k = m.longest_prefix(t, budget)
            assert max(counts[: k + 1]) <= budget and (k == len(t) or counts[k + 1] > budget)


def test_token_counts_query(spark, sf, library):
    for r in rows(queries.op9_token_counts(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id")):
        t = r["text"] or ""
        n = len(library.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)
        assert r["cut_chars"] == len(t) if not r["over_limit"] else len(library.encode(t[: r["cut_chars"]])) <= 4096 < len(library.encode(t[: r["cut_chars"] + 1]))


def test_stored_prefix_counts_answer_other_budgets(spark, sf, odd, library, monkeypatch):
    for docs in (documents(spark, sf).limit(40), odd.where("length(text) < 1000 or text is null")):
        counted = encoding.token_counts(docs, queries.model_path(), prefixes=True).cache()
        text = {}
        for r in docs.collect():
            text.setdefault(r["doc_id"], set()).add(r["text"] or "")
        for r in counted.collect():
            assert any(len(t) == len(r["prefix_counts"]) - 1 and all(len(library.encode(t[:k])) == r["prefix_counts"][k] for k in {*range(0, len(t), 1 + len(t) // 50), len(t)}) for t in text[r["doc_id"]])
            assert r["n_tokens"] == r["prefix_counts"][-1]
        for budget in (0, 7, 300):
            key = lambda d: Counter((r["doc_id"], r["over_limit"], r["cut_chars"]) for r in d.select("doc_id", "over_limit", "cut_chars").collect())
            assert key(encoding.cut_at(counted, budget)) == key(encoding.token_counts(docs, queries.model_path(), budget=budget))
    m, seen = encoding.transducer(queries.model_path()), []
    monkeypatch.setattr(m, "_counts", lambda part, real=m._counts: seen.append(part) or real(part))
    m.prefix_counts("wholly unremembered zyxwvut")
    m.prefix_counts("wholly unremembered zyxwvut")
    assert seen and len(seen) == len(set(seen))


def test_unigram_path():
    """The same machine with additive weights takes the best segmentation."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    import tempfile

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.normalizer_spec.remove_extra_whitespaces = 1, False
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3, 1), ("▁a", -2.5, 1), ("▁ab", -6, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(proto.SerializeToString())
        f.flush()
        m = encoding.PieceTransducer(f.name)
    assert m.encode("ab") == [5, 3] and m.encode("bab") == [1, 3, 4] and m.encode("z") == [1, 0]


# languages


def test_language_id(spark, odd, none):
    import zlib

    docs = documents(spark, "/root/testdata/sf0.01")
    models = language_id.learn(docs)
    got = rows(language_id.identify(docs, models))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and sum(r["rejected"] for r in held) <= 0.01 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    strange = {r["doc_id"]: r for r in rows(language_id.identify(odd, models))}
    assert strange[0]["lang_pred"] == strange[1]["lang_pred"] == strange[12]["lang_pred"] == "und" and strange[0]["score"] == 0 and strange[0]["rejected"]
    assert len(strange) == odd.select("doc_id").distinct().count() and not rows(language_id.identify(none, models))
    empty = language_id.learn(none)
    assert {r["lang_pred"] for r in rows(language_id.identify(odd, empty))} == {"und"}
    junk = spark.createDataFrame([(1, "zqxj kwvz qqxz jjkq zxvq " * 20)], "doc_id long, text string")
    assert rows(language_id.identify(junk, models))[0]["rejected"]


def test_codes_are_no_words():
    """Letters a-z next to digits only count where a text has no other words; other scripts are not split from their digits that way."""
    code = "ab12f0c3de"
    for text, want in [("Hello x1 World_wide", ["hello", "world", "wide"]), (code, ["ab", "f", "c", "de"]), (f"{code} été2 2024年发布", ["été", "年发布"]), ("", []), ("12 _ 3", [])]:
        assert sorted(language_id.words_of(text)) == sorted(want)
    texts = {"en": [f"the thing of the other thing {k}" for k in range(20)], "fr": [f"le chat de la maison verte {k}" for k in range(20)]}
    models = language_id.LanguageModels(texts)
    plain, coded, bare = models.predict(["the other thing", f"the other thing {hashlib.sha256(b'x').hexdigest()}x1", code])
    assert plain[0] == coded[0] == "en" and plain[2] == coded[2] and bare[0] in texts and bare[2] is not None


@pytest.mark.parametrize("left", ["de", "en", "es", "fr"])
def test_rejection_of_a_language_left_out(spark, left):
    """Also where a few rows are mislabelled: some of languages that have models, and in the calibration rows (every eighth) one of the language left out."""
    held, strange, texts = [], [], defaultdict(list)
    for r in sorted(documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang").collect(), key=lambda r: r["text"]):
        if r["doc_id"] % 5 == 0:
            held.append(r)
        elif r["lang"] == left:
            strange.append(r["text"])
        else:
            texts[r["lang"]].append(r["text"])
    langs = sorted(texts)
    wrong = {lang: texts[langs[k - 1]][20:23] for k, lang in enumerate(langs)}
    for k, lang in enumerate(langs):
        texts[lang] = [strange[k], *texts[lang][:7], *wrong[lang], *texts[lang][7:]]
    models = language_id.LanguageModels(texts)
    out = [(r["lang"], x[3]) for r, x in zip(held, models.predict([r["text"] for r in held]), strict=True)]
    foreign, own = [x for lang, x in out if lang == left], [x for lang, x in out if lang != left]
    assert sum(foreign) >= 0.95 * len(foreign) and sum(own) <= 0.02 * len(own)


def test_learning_rows_are_bounded(spark, monkeypatch):
    """Neither repeated ids nor repeated rows bring more rows to the driver than the bounds say."""
    seen = {}
    monkeypatch.setattr(language_id, "LanguageModels", lambda texts, order: seen.update(texts=texts))
    docs = spark.range(3000).selectExpr("0L as doc_id", "concat('text of row ', id % 2000) as text", "if(id % 3 = 0, 'a', 'b') as lang").where("crc32(cast('0' as binary)) % 5 <> 0")
    docs = docs.selectExpr("1L as doc_id", "text", "lang") if not docs.count() else docs
    language_id.learn(docs, rows_per_language=50)
    assert set(seen["texts"]) == {"a", "b"} and all(20 < len(v) <= 50 for v in seen["texts"].values())
    language_id.learn(docs, chars_in_all=400)
    assert all(sum(map(len, v)) <= 200 for v in seen["texts"].values())


def test_every_label_keeps_a_model(spark):
    """Labels with long rows only, labels none of whose rows is drawn, and more labels than a thousand."""
    r = random.Random(8)
    stock = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for lang, letters in (("aa", "abcdeio"), ("long", "uvwxyzo"))}
    text = lambda lang, n: " ".join(r.choice(stock[lang]) for _ in range(n))
    docs = [(i, text("aa", 80), "aa") for i in range(60)] + [(i, text("long", 6000), "long") for i in range(60, 110)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    models = language_id.learn(docs)
    assert models.languages == ["aa", "long"]
    short = spark.createDataFrame([(i, text(("aa", "long")[i % 2], 60)) for i in range(40)], "doc_id long, text string")
    got = rows(language_id.identify(short, models))
    assert all(x["lang_pred"] == ("aa", "long")[x["doc_id"] % 2] and not x["rejected"] for x in got)
    alike = docs.selectExpr("0L as doc_id", "text", "lang")  # one draw for all, above their share
    assert language_id.learn(alike, rows_per_language=1).languages == ["aa", "long"]
    many = spark.range(1500).selectExpr("id as doc_id", "concat('word', id) as text", "concat('l', id) as lang")
    kept = many.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    assert kept > 1000 and len(language_id.learn(many).languages) == kept


def brute_kneser_ney(words, order):
    """Interpolated Kneser-Ney by its textbook definition, with dictionaries: log-probability of a word's characters and end mark."""
    import math

    tables = []
    for n in range(1, order + 1):
        count, left = Counter(), defaultdict(set)
        for w, k in Counter(words).items():
            t = f"\x01{w}\x02"
            for i in range(1, len(t)):
                if i >= n - 1:
                    g = t[i - n + 1 : i + 1]
                    if n == order or i == n - 1:
                        count[g] += k
                    else:
                        left[g].add(t[i - n])
        count.update({g: len(x) for g, x in left.items()})
        ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
        total, kinds = Counter(), Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables.append((count, ones / (ones + 2 * twos) if ones and twos else 0.5, total, kinds))

    def p(g, n):
        if not n:
            return 1 / language_id.ALPHABET
        count, d, total, kinds = tables[n - 1]
        g = g[-n:]
        below = p(g, n - 1)
        if not total[g[:-1]]:
            return below
        return max(count[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * below

    def score(w):
        t = f"\x01{w}\x02"
        return sum(math.log(p(t[max(0, i - order + 1) : i + 1], min(order, i + 1))) for i in range(1, len(t)))

    return score, p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney_is_the_textbook_model(order):
    r = random.Random(order)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(120)]
    words += words[:30]
    score, p = brute_kneser_ney(words, order)
    m = language_id.KneserNey(Counter(words), order)
    models = language_id.LanguageModels({"x": [" ".join(words)]}, order=order)
    tried = [*words[:60], "z", "abz", "ééé", "aaaaaaaaaa"]
    assert m.order == order and [x[0] for x in models.word_scores(tried)] == pytest.approx([score(w) for w in tried], rel=1e-5)
    # a context's probabilities over the alphabet sum to one: letters seen, and the rest of the alphabet, which has equal shares
    for context in ("\x01", "\x01a", "ab", "bcd", "a"):
        seen = "abcdé\x02"
        total = sum(p(context + c, min(order, len(context) + 1)) for c in seen) + (language_id.ALPHABET - len(seen)) * p(context + "z", min(order, len(context) + 1))
        assert total == pytest.approx(1)


# queries and pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r["doc_id"] for r in rows(out)}
    texts = [r["text"] for r in docs.select("doc_id", "text").distinct().collect()]
    assert ids and len(set(texts)) == len(texts)
    assert {r["doc_id"] for r in rows(corpus_pipeline.run(spark, sf))} == ids


def test_pipeline_equals_plain_python(spark, sf, library, monkeypatch):
    """The five decisions one after the other, copies included.  Language models are the repository's, learned here from all rows they may learn from."""
    import math
    import zlib

    import corpus_pipeline

    docs = [r.asDict() for r in documents(spark, sf).collect()]
    texts = defaultdict(list)
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            assert len(r["text"]) <= 20_000
            texts[r["lang"]].append(r["text"])
    models = language_id.LanguageModels({k: sorted(v) for k, v in texts.items()})
    docs = [r for r, x in zip(docs, models.predict([r["text"] or "" for r in docs]), strict=True) if not x[3]]
    last = {}
    for r in docs:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], r["doc_id"]))
    docs = [r for r in docs if last[r["text"]] == r["doc_id"]]
    least = {i: c for i, _, c in brute_components((r["doc_id"], brute_fingerprint(r["text"])) for r in docs)}
    docs = [r for r in docs if least[r["doc_id"]] == r["doc_id"]]
    n = Counter(r["source"] for r in docs)
    want = Counter()
    for r in docs:
        rate = n[r["source"]] ** 0.5 / sum(x**0.5 for x in n.values()) * len(docs) / n[r["source"]]
        u = (int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        copies = next(k for k in range(1000) if sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1)) >= u)
        if copies:
            want[(r["doc_id"], tuple(library.encode(r["text"])))] += copies
    folders = []
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda s, label: folders.append(common.new_folder(s, label)) or folders[-1])
    got = rows(corpus_pipeline.run(spark, sf))
    kept = [os.path.isdir(f.removeprefix("file:")) for f in folders]
    assert kept == [False] * 4 + [True]  # finished stages are removed once the next is written
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and max(want.values()) > 1
    assert all(r["round_trip"] for r in got)


def test_mixing_keeps_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text", "'en' as lang", "if(id < 20, 'a', 'b') as source", "2L as n_chars", "7000 + id as copy", "8000 + id as n_copies", "9000 + id as shuffle_key", "6000 + id as pipeline_copy")
    got = rows(corpus_pipeline.mix(spark, docs, ""))
    assert got and len(got) != len({r["doc_id"] for r in got}) and all((r["copy"], r["n_copies"], r["shuffle_key"], r["pipeline_copy"]) == tuple(k + r["doc_id"] for k in (7000, 8000, 9000, 6000)) for r in got)


def test_pipeline_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {m[0] for n in names if (m := re.match(r"op\d+(?=_)", n))} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(queries.oracle_sql()) <= names


def test_ended_tasks_remember_no_words(spark, sf, monkeypatch):
    """Workers outlive a stage, and what they remember counts in the stages after it."""
    import pyarrow as pa

    docs = documents(spark, sf).select("doc_id", "text", "lang").limit(200)
    batch, tasks, used = pa.RecordBatch.from_pandas(docs.toPandas()), [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append((run, self.columns)))
    totals = language_id.LanguageModels.totals
    monkeypatch.setattr(language_id.LanguageModels, "totals", lambda self, texts: used.append(self) or totals(self, texts))
    m = encoding.transducer(queries.model_path())
    language_id.identify(docs, language_id.LanguageModels({"en": ["some words of a language"], "de": ["einige andere Wörter"]}))
    encoding.encode_pieces(docs, queries.model_path())
    encoding.token_counts(docs, queries.model_path())
    held = [lambda: [len(used[-1].known), used[-1].used], *[lambda: [len(x) for x in (m.young, m.old, m.words, m.old_words, *m.steps, *m.old_steps)]] * 2]
    for (run, columns), holds in zip(tasks, held, strict=True):
        out = run(iter([batch.select(columns)]))
        next(out)
        assert any(holds())
        assert not list(out) and not any(holds())
