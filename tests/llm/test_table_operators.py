import hashlib
import io
import math
import random
from fractions import Fraction

import pytest

from tests.compare import connect, difference, run_sql
from tests.llm.messy import CLASHING, documents, words
from tidemark.llm import mixing, queries, url_filter, va_file, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, folder, spark):
    df = queries.QUERIES[name](spark, folder)
    columns, _, expected = run_sql(connect(folder), queries.ORACLE_SQL[name])
    assert difference(df.columns, [tuple(r) for r in df.collect()], columns, expected) is None


# URL filter


def pages_table(spark, rows):
    rows = [(*r, "-", 7, 7, "-", "-", 7, 7, "-", 7) for r in rows]
    return spark.createDataFrame(rows, f"page_id long, url string, html string, {CLASHING}")


def walked(links, seeds, rounds=200):
    score = {h: 0.15 for h in seeds}
    total = {}
    for a, b, n in links:
        total[a] = total.get(a, 0) + n
    for _ in range(rounds):
        after = {h: 0.15 for h in seeds}
        for a, b, n in links:
            after[b] = after.get(b, 0) + 0.85 * score.get(a, 0) * n / total[a]
        score = after
    return score


def test_trust_and_distrust_walk(spark):
    link = lambda *hosts: "".join(f'<p><A class="x" HREF="https://{h}/p">t</a><a href=/own>o</a>' for h in hosts)
    rules = [url_filter.Rule("good.org/", True), url_filter.Rule("bad.com/", False), url_filter.Rule("bad.com/ok/", True)]
    rows = [
        (1, "http://www.GOOD.org/a?x#y", link("friend.io", "Friend.io", "both.io")), (2, "http://bad.com/", link("good.org")),
        (3, "http://linker.io", link("bad.com", "x.bad.com")), (4, "http://far.io/x", link("linker.io")), (5, "http://friend.io/#f", None),
        (6, "http://both.io/?q", link("bad.com")), (7, "http://x.bad.com/ok/1", ""), (8, "http://notbad.com/", None), (9, None, link("bad.com")),
        (10, "no scheme", None), (11, "http://bad.com", None), (None, "http://linker.io/z", link("bad.com")), (3, "http://linker.io", link("bad.com", "x.bad.com")),
    ]
    pages = pages_table(spark, rows)
    found = url_filter.filter_urls(pages, rules, rounds=200)
    by = {}
    for r in found.collect():
        by.setdefault(r["page_id"], r)
    assert found.count() == len(rows)
    assert [by[k]["host"] for k in (1, 7, 9, 10, 11)] == ["www.good.org", "x.bad.com", "", "", "bad.com"]
    assert [by[k]["path"] for k in (1, 2, 3, 5, 6)] == ["/a", "/", "", "/", "/"]
    assert [by[k]["rule"] for k in (1, 2, 7, 8, 11)] == ["good.org/", "bad.com/", "bad.com/ok/", None, None]
    links = [("www.good.org", "friend.io", 1), ("www.good.org", "both.io", 1), ("bad.com", "good.org", 1), ("linker.io", "bad.com", 3),
             ("linker.io", "x.bad.com", 2), ("far.io", "linker.io", 1), ("both.io", "bad.com", 1)]
    trust = walked(links, {"www.good.org", "x.bad.com"})
    distrust = walked([(b, a, n) for a, b, n in links], set())
    for r in by.values():
        if r["host"]:
            assert math.isclose(r["trust"], trust.get(r["host"], 0), abs_tol=1e-6)
            assert math.isclose(r["distrust"], distrust.get(r["host"], 0), abs_tol=1e-6)
    assert by[8]["verdict"] == by[9]["verdict"] == by[10]["verdict"] == "allow"
    blocked = pages_table(spark, [r for r in rows if r[0] != 11])
    by = {r["page_id"]: r for r in url_filter.filter_urls(blocked, rules, rounds=200).collect()}
    distrust = walked([(b, a, n) for a, b, n in links], {"bad.com"})
    for r in by.values():
        assert math.isclose(r["distrust"], distrust.get(r["host"], 0) if r["host"] else 0, abs_tol=1e-6)
    assert [by[k]["verdict"] for k in (2, 3, 4, 5, 6, 7)] == ["block", "block", "block", "allow", "block" if distrust["both.io"] > trust["both.io"] else "allow", "allow"]
    assert url_filter.filter_urls(pages_table(spark, []), rules).count() == 0


# WARC


def test_archives_give_the_pages_back(spark, tmp_path):
    big = "é" * 700
    rows = [
        (1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (5, "http://b/", big), (None, "http://n/", big),
        (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "z" * 300_000), (11, "u", "\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = pages_table(spark, rows)
    manifest = warc.write_warc(pages, f"{tmp_path}/w")
    found = warc.read_warc(manifest, with_payload=True).collect()
    assert len(found) == len(rows) and sum(r[1] for r in manifest.select("path", "n_records").collect()) == len(rows)
    html = {}
    for page_id, _, text in rows:
        html[page_id] = (text or "").encode()
    for r in found:
        data = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = r["page_id"] in (1, 3, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    assert {r["url"] for r in found if r["page_id"] == 5} == {"http://b/%0D%0AX: y", "http://b/"}
    assert warc.read_warc(warc.write_warc(pages_table(spark, []), f"{tmp_path}/e")).count() == 0


def test_damage_is_found():
    import zlib

    def member(data):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        return engine.compress(data) + engine.flush()

    body = b"text " * 100_000
    record = warc._record(4, "u", body, hashlib.sha1(body).hexdigest(), len(body), None)
    whole = member(record) * 2
    assert [r[0] for r in warc.read_records(io.BytesIO(whole))] == [4, 4]
    for bad in (record.replace(b"text text", b"text taxt", 1), record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WORK/1.1", 1)):
        with pytest.raises(warc.DamagedRecord):
            list(warc.read_records(io.BytesIO(member(record) + member(bad))))
    with pytest.raises(warc.DamagedRecord):
        list(warc.read_records(io.BytesIO(whole[:-20])))


# Mixing


def test_targets_fill_up():
    sizes, weights = {"a": 10, "b": 100, None: 90}, {"a": 3, "b": 1, None: 2}
    found = mixing.filled_targets(sizes, weights, Fraction(3, 2), 2)
    assert found == {"a": 20, "b": 100, None: 180}
    assert mixing.filled_targets({"a": 0}, {"a": 1}, Fraction(3, 2), 2) == {"a": 0}
    assert mixing.filled_targets({}, {}, Fraction(3, 2), 2) == {}


def test_flow_repeats_only_when_it_must():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    found = mixing.routed(patterns, {"a": 15, "b": 15}, 3)
    used = {p: sum(s.values()) for p, s in found.items()}
    assert used == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    found = mixing.routed(patterns, {"a": 40, "b": 10}, 3)
    assert sum(s.get("a", 0) for s in found.values()) == 40 and sum(s.get("b", 0) for s in found.values()) == 10
    assert found[("b",)] == {"b": 10}
    assert mixing.intervals(10, {"a": 15, "b": 5}) == [(0, 0, 10, "a"), (1, 0, 5, "a"), (1, 5, 10, "b")]


def test_mix_of_messy_documents(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 40), 50) for _ in range(400)] + [None, "", "  ", "one", "one"]
    sources = [rng.choice(["a", "a", "a", "a", "B", "c", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    found = mixing.mix_report(spark, docs).collect()
    again = mixing.mix_report(spark, docs.repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) and len(found) == len(texts)
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    taken: dict = {}
    for r in found:
        own = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sum(size[i] for i, s in enumerate(sources) if s == own)
        taken.setdefault(own, [0, r["target"]])[0] += r["taken"]
    assert all(abs(have - want) <= 5 for have, want in taken.values())
    mixed = mixing.mixed_documents(docs, mixing.shared_quotas())
    assert mixed.columns == docs.columns
    assert sum(size[r["doc_id"]] for r in mixed.collect()) == sum(have for have, _ in taken.values())
    assert mixing.mix_report(spark, documents(spark, [])).count() == 0


def test_mix_keeps_rows_of_null_and_repeated_ids(spark):
    from collections import Counter

    rng = random.Random(11)
    texts = [f"text {k} " + words(rng, rng.randrange(1, 40), 50) for k in range(300)] + ["the same words"] * 30
    sources = [rng.choice(["a", "a", "B", None]) for _ in texts]
    ids = [None if k % 5 == 0 else 7 if k % 5 == 1 else k for k in range(300)] + [None] * 15 + [8] * 15
    docs = documents(spark, texts, sources, ids)
    found = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(docs, mixing.shared_quotas()).collect()]
    again = mixing.mixed_documents(docs.repartition(3), mixing.shared_quotas()).collect()
    assert Counter(found) == Counter((r["doc_id"], r["text"], r["source"]) for r in again)
    rows, uses = Counter(zip(ids, texts, sources)), Counter(found)
    assert all(n <= 2 * rows[r] for r, n in uses.items())
    size = lambda t: len(t.split())
    sizes = {s: sum(size(t) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    wanted = mixing.shared_quotas()(sizes)
    for s, words_wanted in wanted.items():
        assert abs(sum(size(t) for _, t, x in found if x == s) - words_wanted) <= 5
    everything = mixing.mixed_documents(docs, lambda w: {s: Fraction(2 * n) for s, n in w.items()})
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in everything.collect()) == rows + rows


def test_mix_of_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = [words(rng, rng.randrange(5, 30), 50) for _ in range(300)]
    docs = documents(spark, texts, [rng.choice(["a", "b", "a b", "b a"]) for _ in texts]).withColumn("m", F.split("source", " "))
    rows = mixing.sized(docs, "m")
    taken, known = mixing.mix(rows, lambda words: {"a": words["a"] * Fraction(6, 10), "b": words["b"] * Fraction(1, 2)})
    have = {"a": 0, "b": 0}
    for r in taken.collect():
        assert set(r["takers"]) <= set(r["pattern"])
        assert len(r["takers"]) <= 1  # the quotas can be met without repetition
        for s in r["takers"]:
            have[s] += r["size"]
    wanted = {s: float(w) for s, w in known["wanted"].items()}
    assert all(abs(have[s] - wanted[s]) <= 10 for s in have)


# Exact search


def test_search_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(va_file, "BLOCK", 40)
    monkeypatch.setattr(va_file, "GROUP", 3)
    monkeypatch.setattr(va_file, "CELLS", 8)
    rng = random.Random(10)
    vectors = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(200)]
    vectors += [vectors[3]] * 60 + [[0.0] * 6] * 20
    rows = [(k, v) for k, v in enumerate(vectors)] + [(7, vectors[7])]
    rows += [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (None, vectors[0]), (1100, []), (1150, [0.5, 0.5]), (1151, [0.5, 0.25])]
    data = spark.createDataFrame([(i, v, 1, "-") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    found = sorted(map(tuple, va_file.search(spark, data, "vec_id % 50 = 0", 5).select("query_id", "rank", "vec_id", "score").collect()))
    kept = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in data.collect() if r[0] is not None and r[1] and None not in r[1] and all(map(math.isfinite, r[1]))]
    kept = [list(x) for x in {(i, tuple(v)) for i, v in kept}]
    expected = []
    for q, own in kept:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in kept if i != q and len(v) == len(own))
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert found == sorted(expected)
    assert va_file.search(spark, data.limit(0), "vec_id % 50 = 0").count() == 0
