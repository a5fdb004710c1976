"""SentencePiece spans, the filter audit and the importance draw against the library, SQL and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from tests.compare import connect, difference
from tests.llm.messy import documents, messy_texts
from tidemark.llm import filter_audit, importance_resampling, queries, sentencepieces

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PARTS = [
    " ", " ", " ", "  ", "▁", "\n", "\t", "a", "word", "Wörd", "don't", "12", ",", "é", "é", "你好", " ", "　", "​", "ﬁ", "①",
    "Å", "Å", "ｶﾞ", "한", "하", "🤦🏼", "\x00", "\x01", "<s>", "</s>", "<0x41>", "ͅ", "´", " ́", "…", "㍿", "the", "The",
]


def fuzz(seed: int, n: int = 700) -> list[str]:
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a", " a", "a ", "▁", "▁a", "a▁ b", "a ▁b", "a▁", "x" * 5000, "a  " * 400, "é" * 300]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return queries.public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def variants(model, tmp_path_factory):
    """The model with the compiled map of NFKC, with and without stripping; without byte pieces; with own symbols."""
    rule = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    plain = pb.ModelProto.FromString(open(model, "rb").read())
    folder, found = tmp_path_factory.mktemp("models"), {"plain": model}
    for name in ("mapped", "strips", "unknown", "symbols", "suffix"):
        own = pb.ModelProto()
        own.CopyFrom(plain)
        if name in ("mapped", "strips"):
            own.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
        own.normalizer_spec.remove_extra_whitespaces = name in ("strips", "suffix")
        if name == "unknown":
            own.trainer_spec.byte_fallback = False
            for p in own.pieces:
                if p.type == pb.ModelProto.SentencePiece.BYTE:
                    p.type = pb.ModelProto.SentencePiece.UNUSED
        if name == "symbols":
            p = next(p for p in own.pieces if p.piece == "word")
            p.type = pb.ModelProto.SentencePiece.USER_DEFINED
        own.trainer_spec.treat_whitespace_as_suffix = name == "suffix"
        found[name] = f"{folder}/{name}.model"
        with open(found[name], "wb") as f:
            f.write(own.SerializeToString())
    return found


def library_spans(library, text: str) -> tuple:
    pieces = library.encode(text, return_type="proto").pieces
    return [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]


@pytest.mark.parametrize("name", ["plain", "mapped", "strips", "unknown", "symbols", "suffix"])
def test_ids_and_spans_are_the_library_s(variants, name):
    own, texts = sentencepieces.Encoder(variants[name]), fuzz(5)
    assert own.cuts == (name in ("plain", "mapped", "unknown"))
    for step in (1, 40, len(texts)):  # cuts meet different neighbours, and remembered ones
        for lo in range(0, len(texts) if step > 1 else 200, step):
            part = texts[lo : lo + step]
            values, n = own.encode(pa.array([t.encode() for t in part], pa.binary()))
            assert len(n) == len(part)
            at = 0
            for t, size in zip(part, n):
                found = [v[at : at + size].tolist() for v in values]
                at += size
                ids, begins, ends = library_spans(own.library, t)
                assert found[0] == ids == own.library.encode(t), t
                if name != "unknown":  # the library merges neighbouring unknown pieces only in its surfaces
                    assert found[1:] == [begins, ends], t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("strips", [False, True])
def test_normalised_text_and_offsets(rule, strips):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=strips, add_dummy_prefix=True, escape_whitespaces=True)
    spec = pb.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    own = sentencepieces.Normaliser(spec, suffix=False)
    for t in fuzz(6, 600):
        text, places = library.normalize(t, with_offsets=True)
        found, align = own.whole(t.encode())
        assert found.decode() == text, t
        in_characters = np.cumsum([0, *[len(c.encode()) for c in t]]).tolist()
        starts = np.cumsum([0, *[len(c.encode()) for c in text]])
        assert [in_characters.index(x) for x in align[starts]] == places, t


def test_malformed_bytes(model):
    own = sentencepieces.Encoder(model)
    bad = [b"ab\xff c", b"\xe2\x96 x", b"\xed\xa0\x80", b"ok \xc0\xaf", b"\xf8\x88", b"tail \xe2"]
    values, n = own.encode(pa.array(bad, pa.binary()))
    at = 0
    for t, size in zip(bad, n):
        assert values[0][at : at + size].tolist() == own.library.encode(t)
        assert values[2][at : at + size].max() == len(t)
        at += size


def test_memory_of_cuts_is_bounded(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 20)
    own, texts = sentencepieces.Encoder(model), fuzz(7, 200)
    for lo in range(0, len(texts), 10):
        part = texts[lo : lo + 10]
        values, n = own.encode(pa.array([t.encode() for t in part], pa.binary()))
        assert values[0].tolist() == [i for t in part for i in own.library.encode(t)]


def test_pieces_of_a_table(spark, model):
    texts = [*fuzz(8, 60), None, None, "long " * 60_000, "x" * 100_000]
    docs = documents(spark, texts)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {r["doc_id"]: r for r in sentencepieces.round_trip(docs, model).collect()}
    spans = {r["doc_id"]: r for r in sentencepieces.encode(docs, model).collect()}
    assert len(found) == len(spans) == len(texts)
    for i, t in enumerate(texts):
        assert found[i]["ids"] == spans[i]["ids"] == library.encode(t or "")
        assert found[i]["decoded"] == library.decode(library.encode(t or ""))
        raw, r = (t or "").encode(), spans[i]
        assert r["text"] == t and b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw
    assert sentencepieces.round_trip(documents(spark, []), model).count() == 0
    repeated = documents(spark, ["a b", "a b"], ids=[None, None])
    assert [r["doc_id"] for r in sentencepieces.round_trip(repeated, model).collect()] == [None, None]


def test_piece_digests_of_documents(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op11_sentencepieces"](spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# Filter audit

RULES = {
    "A": lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) < 200,
    "B": lambda t: 100 * len(set(w := re.findall(r"[^\x20\x09-\x0D]+", t))) < 50 * len(w),
    "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
    "D": lambda t: bool(re.search("[#$%&*|]", t)),
}


def brute_audit(rows: list[tuple], labels: list[tuple]) -> set[tuple]:
    """``rows``: (doc_id, text, part)."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    fails = []
    for i, t, _ in rows:
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append({x for x, rule in RULES.items() if rule(t)} | ({"E"} if copy else set()))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    found = []
    for part in {p for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if p == part]
        shapley, of_part = Counter(), []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                left = [(i, f) for i, f in mine if not f & set(order[:k])]
                gone = [i for i, f in left if x in f]
                shapley[x] += len(gone)
                of_part.append((
                    part, "".join(order), k + 1, len(left) - len(gone), len(gone), sum(x in f for _, f in mine) - len(gone),
                    sum(f == {x} for _, f in mine), sum(i in good for i in gone if i is not None), sum(i in toxic for i in gone if i is not None), x,
                ))
        found += [(*r[:-1], shapley[r[-1]]) for r in of_part]
    return set(found)


def test_audit_of_messy_rows(spark):
    rng = random.Random(9)
    texts = messy_texts(rng) + ["A B # " * 50, " ".join(f"u{k}" for k in range(230)), "X" * 50, None, "", "same text", "same text", "same text"] * 2
    ids = [k if k % 9 else None for k in range(len(texts))]
    ids[-1] = ids[-2] = ids[-3]  # repeated rows
    langs = [rng.choice(["en", "de", None, ""]) for _ in texts]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(len(texts)) if i % 2] + [(1, 1, 0), (None, 1, 1), (7, 0, 1)]
    table = spark.createDataFrame([(*r, "-") for r in labels], "doc_id long, quality int, toxic int, n string")
    docs = documents(spark, texts, ids=ids, langs=langs)
    found = filter_audit.audit(docs, table, filter_audit.text_rules(), "E", F.col("lang")).collect()
    assert len(found) == 600 * 3
    assert {tuple(r) for r in found} == brute_audit(list(zip(ids, texts, langs)), labels)


def test_audit_of_nothing_and_of_fewer_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = filter_audit.text_rules()
    assert filter_audit.audit(documents(spark, []), labels, rules, "E", F.col("lang")).count() == 0
    docs = documents(spark, ["a b", "a b", "C#"])
    rows = filter_audit.audit(docs, labels, {x: rules[x] for x in "CD"}, None, F.lit("all")).collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in rows) == [
        ("CD", 1, 2, 1, 0, 1), ("CD", 2, 2, 0, 1, 1), ("DC", 1, 2, 1, 0, 1), ("DC", 2, 2, 0, 1, 1),
    ]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {x: F.lit(True) for x in "ABCDEFG"}, None, F.lit(""))


# Importance resampling


def brute_draw(rows: list[tuple], target: list, percent=10, least=20, shortest=1, longest=1, buckets=10_000) -> dict:
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in runs(x)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    found, drawn = [], []
    for k, (i, text) in enumerate(rows):
        n, hashed = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, hashed))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(hashed), weight, score, None])
        if n >= least:
            drawn.append((-score, i is None, i or 0, k))
    for place, key in enumerate(sorted(drawn)[: percent * len(drawn) // 100]):
        found[key[-1]][-1] = place + 1
    return Counter(map(tuple, found))


@pytest.mark.parametrize("percent, shortest, longest", [(10, 1, 1), (55, 1, 2), (100, 2, 3), (1, 3, 3)])
def test_draw_of_messy_rows(spark, monkeypatch, percent, shortest, longest):
    rng = random.Random(10)
    texts = messy_texts(rng) * 2
    ids = [k % 60 if k % 11 else None for k in range(len(texts))]
    target = ["w1 w2 w3 changed w5", None, "", "Your own text, and ours."]
    monkeypatch.setattr(importance_resampling, "PIVOTS", 8)
    found = importance_resampling.resample(
        documents(spark, texts, ids=ids), documents(spark, target), percent, 20, shortest, longest, buckets=50
    )
    # Rows equal in score and doc_id are interchangeable.
    assert Counter(map(tuple, found.collect())) == brute_draw(list(zip(ids, texts)), target, percent, 20, shortest, longest, 50)


def test_every_kth_key_is_found(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.randrange(5), rng.choice([None, 1, 2, 3]), k) for k in range(60)]
    spark.createDataFrame(rows, "score long, doc_id long, row long").write.parquet(f"{tmp_path}/keys")
    table = spark.read.parquet(f"{tmp_path}/keys")
    keys = sorted((-s, i is None, i or 0, k) for s, i, k in rows)
    for k in (1, 2, 29, 59, 60):
        assert tuple(importance_resampling.kth_key(table, k, pivots=3)) == keys[k - 1]


def test_draw_of_few_or_no_rows(spark):
    target = documents(spark, ["a b c"])
    assert importance_resampling.resample(documents(spark, []), target).count() == 0
    few = importance_resampling.resample(documents(spark, ["a " * 30, None, ""]), documents(spark, [])).collect()
    assert [r["rank"] for r in few] == [None] * 3 and sorted(r["n_features"] for r in few) == [0, 0, 30]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_importance_resampling"])
def test_queries_match_their_sql(spark, name):
    df, sql = queries.QUERIES[name](spark, FOLDER), connect(FOLDER).sql(queries.ORACLE_SQL[name])
    assert difference(df.columns, [tuple(r) for r in df.collect()], sql.columns, sql.fetchall()) is None
