import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgermark.llm import language, neighbours, order_minhash
from ledgermark.llm.language_query import op4_language_fusion
from ledgermark.llm.order_minhash_query import op2_order_minhash
from tests.llm.samples import SCHEMA, WORDS, awkward, clashing, frame, prose

SF = "/root/testdata/sf0.001"


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def xx(*values) -> int:
    """Hash of longs, ints (as pairs with a width) and strings, one seeding the next."""
    seed = 42
    for v in values:
        if isinstance(v, str):
            data = v.encode()
        else:
            v, width = v if isinstance(v, tuple) else (v, 8)
            data = (v % (1 << 8 * width)).to_bytes(width, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def signature(text: str | None, k=order_minhash.K, length=order_minhash.LENGTH, size=order_minhash.SIZE) -> list[int]:
    words = [xx(w) for w in WORDS.findall(text or "")]
    kmers = [xx(*words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [xx(*words)] if words else []
    if not kmers:
        return [0] * size
    bits, seen, order = order_minhash.PLACE_BITS, {}, []
    for place, h in enumerate(kmers):
        h >>= bits
        n = seen[h] = seen.get(h, -1) + 1
        order.append(((h if n == 0 else xx(h, (n, 4)) >> bits), place))
    order.sort()
    out = []
    for b in range(size):
        # rotation b of the hash: the smallest from the b-th part of the range on, round the end
        low = (b - size // 2) << (64 - bits - (size.bit_length() - 1))
        turned = sorted(order, key=lambda x: (x[0] < low, x))
        taken = [turned[j % len(turned)] for j in range(length)]
        taken.sort(key=lambda x: (x[1], x[0] % (1 << 38)))
        out.append(xx((b, 4), *[h % (1 << 38) for h, _ in taken]) & 0xFFFFFFFF)
    return out


def test_signatures_against_brute_force(spark):
    texts = [t for _, t, *_ in awkward()] + [prose(i, 3 + 7 * i) for i in range(20)] + ["a b c d e f " * 9, "x " * 50]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = order_minhash.with_signature(clashing(frame(spark, rows)), "text", "sig").collect()
    for r in got:
        assert r["sig"] == signature(r["text"]), r["text"][:50]
    three = order_minhash.with_signature(frame(spark, rows[:16]), "text", "sig", k=2, length=3, size=16).collect()
    assert all(r["sig"] == signature(r["text"], 2, 3, 16) for r in three)


def test_order_and_edits_matter(spark):
    base = [f"w{i}" for i in range(400)]
    edited = list(base)
    for i in range(0, 400, 40):
        edited[i] = f"z{i}"
    blocks = base[200:] + base[:200]
    rows = [(i, " ".join(t), None, None, None) for i, t in enumerate([base, base, edited, blocks, [f"v{i}" for i in range(400)]])]
    sig = {r["doc_id"]: r["sig"] for r in order_minhash.with_signature(frame(spark, rows), "text", "sig").collect()}
    near = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / len(sig[a])
    assert near(0, 1) == 1 and near(0, 4) == 0
    assert 0.3 < near(0, 2) < 1
    assert 0.25 < near(0, 3) < 0.9  # the k-mers are the same, their order is not


def check_next(spark, rows, got):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in got}
    for i, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert by[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = signature(text), signature(edited), signature(following)
        assert by[doc_id]["n_chars"] == len(text)
        assert by[doc_id]["fingerprint"] == "".join(f"{h:08x}" for h in a)
        assert by[doc_id]["near_edited"] == sum(x == y for x, y in zip(a, b, strict=True)) / 64
        assert by[doc_id]["near_next"] == sum(x == y for x, y in zip(a, c, strict=True)) / 64


def test_query_against_brute_force(spark, tmp_path):
    unique = {r[0]: r for r in awkward() if r[0] is not None}
    rows = [*unique.values(), (None, prose(77, 30), None, None, None)]
    rows += [(i * i + 100, prose(i, i), None, None, None) for i in range(1, 60)]
    clashing(frame(spark, rows)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check_next(spark, [(r[0], r[1]) for r in rows], op2_order_minhash(spark, str(tmp_path)).collect())
    frame(spark, [], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op2_order_minhash(spark, f"{tmp_path}/none").collect() == []
    frame(spark, rows[5:6]).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert op2_order_minhash(spark, f"{tmp_path}/one").first()["near_next"] == 1


def test_repeated_ids_keep_their_rows(spark):
    rows = [(7, "a b c", None, None, None)] * 3 + [(7, "d e", None, None, None), (None, None, None, None, None), (None, "x", None, None, None)]
    assert order_minhash.edited_by_next(frame(spark, rows)).count() == len(rows)


def test_range_numbers(spark):
    bounds = [-5, 0, 3, 3_000_000_000]
    values = [-6, -5, -1, 0, 2, 3, 4, 2_999_999_999, 3_000_000_000, 9_000_000_000]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint").withColumn("n", neighbours.range_number(F.col("v"), bounds))
    assert all(r["n"] == (sum(b <= r["v"] for b in bounds) if r["v"] is not None else 0) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy_of_texts_alone(spark, docs):
    train, held = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    names, table = language.train(train)
    assert names == ["de", "en", "es", "fr"]
    rows = held.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("declared"), F.lit("").alias("address"), F.lit("").alias("host"), "lang")
    scored = language.text_scores(rows, names, table)
    got = language.fused(language.with_sources(scored), names).join(held.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    right = sum(r["language"] == r["lang"] for r in got) / len(got)
    assert right > 0.98
    assert sum(r["kept"] for r in got) / len(got) > 0.98


def test_evidence_settles_what_texts_leave_open(spark, docs):
    texts = [None, "", "123 456", "ou", "la que"] * 4
    rows = [(1000 + i, t, "fr-FR" if i % 2 else None, f"https://www.h{i % 3}.example.fr/p", f"h{i % 3}.example.fr") for i, t in enumerate(texts)]
    french = docs.filter("lang = 'fr'").limit(100).select(
        "doc_id", "text", F.lit("fr").alias("d"), F.lit("http://x.example.fr/1").alias("a"), F.concat(F.lit("h"), (F.col("doc_id") % 3).cast("string"), F.lit(".example.fr")).alias("h")
    )
    table = spark.createDataFrame(rows, "id bigint, text string, declared string, address string, host string").unionByName(french.toDF("id", "text", "declared", "address", "host"))
    got = {r["id"]: r for r in language.identified(table, docs).filter("id >= 1000").collect()}
    assert len(got) == 20
    for i, text in enumerate(texts):
        r = got[1000 + i]
        assert (r["declared"], r["suffix"]) == ("fr" if i % 2 else "", "fr")
        if text != "la que":
            assert r["language"] is None and not r["kept"] and r["posterior"] == 0
        elif i % 2:  # the text alone would be Spanish
            assert r["text_language"] == "es" and r["language"] == "fr" and r["kept"]


def test_query_has_a_row_for_every_document(spark):
    got = op4_language_fusion(spark, SF).collect()
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    assert sum(r["language"] == want[r["doc_id"]] for r in got) > 0.97 * len(got)
    assert any(r["suffix"] for r in got)


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward() + [(300 + i, prose(i, 80), "en" if i % 2 else "de", "a", 1) for i in range(30)]
    df = clashing(frame(spark, rows))
    kept = language.accepted(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(9) == 3 and 0 not in ids and 1 not in ids and 2 not in ids
    assert language.accepted(frame(spark, [], SCHEMA)).collect() == []
    assert language.accepted(frame(spark, [(1, "some text", None, None, 9)])).collect() == []


def test_rare_labels_are_languages_at_any_size(spark, docs):
    other = lambda i: " ".join("".join("ŵŷxqzkj"[ord(c) % 7] for c in w) for w in prose(i, 60).split())
    common = docs.filter("lang in ('en', 'fr')").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10_000_000 + i, other(i), "zz") for i in range(4)], "doc_id bigint, text string, lang string")
    labelled = common.unionByName(rare)
    drawn = {r["lang"]: r["count"] for r in language.training_rows(labelled, sample=30).groupBy("lang").count().collect()}
    assert drawn["zz"] == 4 and 10 <= drawn["en"] <= 60 and 10 <= drawn["fr"] <= 60
    names, table = language.train(labelled, sample=30)
    assert names == ["en", "fr", "zz"]
    texts = [other(2), other(3), "%!? ()-+ ÆØÅ Ωδ 漢字 Жщ" * 20]
    rows = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], "id bigint, text string, declared string, address string, host string")
    rows = rows.unionByName(common.select(F.col("doc_id") + 100, "text", F.lit(""), F.lit(""), F.lit("")).toDF(*rows.columns))
    got = {r["id"]: r["language"] for r in language.fused(language.with_sources(language.text_scores(rows, names, table)), names).collect()}
    assert (got[0], got[1]) == ("zz", "zz") and got[2] != "zz"
    assert sum(x == "zz" for i, x in got.items() if i >= 100) < 0.01 * len(got)
