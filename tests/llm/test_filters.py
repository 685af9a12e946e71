"""URL filters, shard placement, quality rules and line dedup on small hand-made tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.llm import line_dedup, quality, sharding, url_rules

DOCS = "doc_id long, text string, lang string, __id string, __text int, __m int, j int, h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "own", 1, 2, 3, 4) for i, t in rows], DOCS)


# ------------------------------------------------------------------ urls

def judged(spark, urls, rules=url_rules.RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("digest", F.lit("x"))
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULE_SCHEMA)).collect()
    return {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_urls_hosts_paths_and_precedence(spark):
    got = judged(spark, ["http://A.Example.NET/en/1?x#y", "http://example.net/", "http://notexample.net/en/", "https://x.org/fr/",
                         "https://x.org/fr", "http://net", "http://net/", "//a.net/", None, "", "http://example.com/de/x://y",
                         "http://example.com?/de/", "http://Ä.NET/", "a\nb://q.net/z"])
    assert got["http://A.Example.NET/en/1?x#y"] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got["http://example.net/"] == ("example.net", "/", "net/", "block")
    assert got["http://notexample.net/en/"][2:] == ("net/", "block")
    assert got["https://x.org/fr/"][2:] == ("org/fr/", "allow")
    assert got["https://x.org/fr"][2:] == (None, "allow")
    assert got["http://net"] == ("net", "", None, "allow")
    assert got["http://net/"][2] == "net/"
    assert got["//a.net/"] == got[None] == got[""] == ("", "", None, "allow")
    assert got["http://example.com/de/x://y"][2:] == ("example.com/de/", "block")
    assert got["http://example.com?/de/"] == ("example.com", "", None, "allow")
    assert got["http://Ä.NET/"][0] == "Ä.net"
    assert got["a\nb://q.net/z"][2] == "net/"


def test_url_rule_ties_repeats_and_empty_tables(spark):
    rules = [("a.b", "/x", "allow"), ("b", "/xyy", "block"), ("c", "/", "allow"), ("c", "/", "block"), (None, "/", "block"), ("d", None, "block")]
    got = judged(spark, ["h://a.b/xyyz", "h://c/", "h://d/"], rules)
    assert got["h://a.b/xyyz"][2] == "a.b/x"        # as long as b/xyy with the longer host
    assert got["h://c/"][3] == "block"
    assert got["h://d/"][2] is None
    pages = spark.createDataFrame([(1, "h://c/")] * 3 + [(None, None)] * 2, "page_id long, url string")
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULE_SCHEMA))
    assert Counter(r.page_id for r in out.collect()) == {1: 3, None: 2}
    none = spark.createDataFrame([], url_rules.RULE_SCHEMA)
    assert [r.verdict for r in url_rules.judge_urls(pages, none).collect()] == ["allow"] * 5
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0


# -------------------------------------------------------------- sharding

def test_table_is_filled_in_turns_and_moves_little():
    names = [f"s{i}" for i in range(7)]
    t = sharding.fill_table(names, 1009)
    n = np.bincount(t, minlength=7)
    assert n.sum() == 1009 and n.max() - n.min() <= 1

    def plain(shards, size):
        orders = [[(sharding._hash(s, "offset") % size + k * (sharding._hash(s, "step") % (size - 1) + 1)) % size for k in range(size)] for s in shards]
        out, turn = {}, 0
        while len(out) < size:
            out[next(x for x in orders[turn % len(shards)] if x not in out)] = turn % len(shards)
            turn += 1
        return [out[i] for i in range(size)]

    assert plain(names[:3], 101) == sharding.fill_table(names[:3], 101).tolist()
    fewer = sharding.fill_table(names[:-1], 1009)
    assert ((t != fewer) & (t != 6)).mean() < 0.25


def test_table_rejects_bad_parameters():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)
    assert sharding.fill_table(["a"], 2).tolist() == [0, 0]


def test_placement_keeps_all_rows(spark):
    df = spark.createDataFrame([(i % 50 if i % 9 else None, i, "c") for i in range(500)], "doc_id long, slot int, shard string")
    out = sharding.place(df, ["doc_id"]).collect()
    assert len(out) == 500 and len({(r.doc_id, r.shard, r.slot) for r in out}) == len({r.doc_id for r in out})
    filled = sharding.fill_table(sharding.SHARDS)
    assert all(sharding.SHARDS[filled[r.slot]] == r.shard for r in out)
    assert sharding.place(df.limit(0), ["doc_id"]).count() == 0
    many = sharding.place(spark.range(64_000).withColumnRenamed("id", "doc_id"), ["doc_id"]).groupBy("shard").count().collect()
    assert len(many) == 64 and max(r["count"] for r in many) < 1300


# --------------------------------------------------------------- quality

def plain_measures(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


TEXTS = ["", None, "one two", "a b c d e a b c d e", "x\x1cy z\u00a0w\u2003v", "été à la\nété à la\n\n \nfin", "a a a a a a a",
         "#### <b> $5 & 7%|", " lead\ttab\x0bvt\x0cff\rcr ", "WORD " * 30, ("the cat sat on the mat " * 3000), "日本 語 𝄞 " * 9,
         "one two three four five six seven eight nine ten", "a b c d e x a b c d e a b c d e"]


def test_ledger_equals_plain_counts(spark):
    rows = list(enumerate(TEXTS)) + [(None, "a b c d e a b c d e"), (3, "a b c d e a b c d e")]
    out = quality.apply_policy(quality.ledger(docs(spark, rows)))
    assert out.count() == len(rows)
    for r in out.collect():
        if r.doc_id is not None:
            m = plain_measures(TEXTS[r.doc_id] or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, TEXTS[r.doc_id][:30]
            assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
            assert not (r.base_failed and r.kept)


def test_policies_ablations_and_empty_table(spark):
    book = quality.ledger(docs(spark, list(enumerate(TEXTS)))).cache()
    rows = book.collect()
    for version in quality.POLICIES:
        enforced = quality.mask(quality.POLICIES[version])
        for a in quality.ablations(book, version).collect():
            bit = quality.mask([a.rule])
            assert a.n_failed == sum(1 for r in rows if r.failed & bit)
            assert a.n_only == sum(1 for r in rows if r.failed & enforced == bit)
            assert a.n_kept_without == sum(1 for r in rows if not r.failed & enforced & ~bit)
    assert quality.ledger(docs(spark, [(1, "x")]).limit(0)).count() == 0
    kept = quality.keep_passing(docs(spark, list(enumerate(TEXTS))))
    assert kept.columns == docs(spark, [(1, "x")]).columns
    passing = {r.doc_id for r in quality.apply_policy(book).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == passing and 12 in passing


# ------------------------------------------------------------ line dedup

def plain_line_dedup(rows):
    """(id, text) -> remaining text, by the stated rule, for distinct rows."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        h = [int(hashlib.md5(lines[k].encode()).hexdigest()[:8], 16) for k in worded]
        gone = set()
        for s in range(len(worded) - 1):
            e = s + 1
            while e + 1 < len(worded) and e - s < line_dedup.MAX_LINES - 1 and (h[e] + line_dedup.MULTIPLIER * h[e - 1]) % line_dedup.DIVISOR == 0:
                e += 1
            chunk = "\n".join(lines[worded[s]:worded[e] + 1])
            if chunk in seen:
                gone.update(range(worded[s], worded[e] + 1))
            seen.add(chunk)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_the_rule(spark):
    base = [f"line {k} of a long shared passage" for k in range(40)]
    rows = [(i, "\n".join([f"own {i}", *base[i % 7:20 + i % 11], f"end {i}", *base[25:]])) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n"), (103, "\n\n\n\n\n"), (104, "single"), (105, "single"), (None, "\n".join(base)),
             (106, "\n".join(base * 200))]
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns == [*docs(spark, rows[:1]).columns, "__lines"]
    got = {r.doc_id: r for r in out.collect()}
    want = plain_line_dedup(rows)
    assert len(got) == len(rows) and got[100].text is None
    for i, t in want.items():
        assert (got[i].text or "") == t, i
    assert sum(r["__lines"].n_removed_lines for r in got.values()) > 100
    assert got[104].text == got[105].text == "single"


def test_line_dedup_keeps_a_copy_of_every_line_and_finds_short_passages(spark):
    rows, passages = [], {}
    for i in range(300):
        shared = [f"shared {i % 100} line {k}" for k in range(2 + i % 4)]
        passages[i % 100] = shared
        rows.append((i, "\n".join([f"own {i} a", "", *shared[:1], "  ", *shared[1:], f"own {i} b", "", "seen in many", "", f"own {i} c"])))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    want = plain_line_dedup(rows)
    assert {i: "\n".join(t) for i, t in got.items()} == want
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in got.values() for x in t}
    for i, t in got.items():   # own lines and lines that repeat alone stay
        assert {f"own {i} a", f"own {i} b", f"own {i} c", "seen in many"} <= set(t)
    whole = sum(not any(x.startswith("shared") for x in got[i]) for i in range(100, 300))
    assert whole > 150


def test_line_dedup_repeated_rows_and_empty_table(spark):
    text = "\n".join(f"l{k}" for k in range(12))
    out = line_dedup.dedup_lines(docs(spark, [(1, text), (1, text), (2, text)]))
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got[0][1] == got[1][1] == text and len(got[2][1]) < len(text)
    assert line_dedup.dedup_lines(docs(spark, [(1, text)]).limit(0)).count() == 0


def test_line_dedup_plan_has_no_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, [(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
