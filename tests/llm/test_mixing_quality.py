import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermark.llm import mixing, quality
from ledgermark.llm.mixing_query import ORACLES, op7_systematic_mixture
from ledgermark.llm.quality_query import op3_adaptive_quality
from ledgermark.llm.shared import saved
from tests.llm.samples import SCHEMA, WORDS, awkward, clashing, frame, prose
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("mixed"))
    rows = [r for r in awkward() if r[0] is not None]
    rows += [(100 + i, prose(i, 5 + i), "en", "hot", 1) for i in range(120)]
    clashing(frame(spark, rows)).drop("size").repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def test_mixture_against_sql(spark):
    assert compare(spark, connect(SF), op7_systematic_mixture, ORACLES["op7_systematic_mixture"], SF) == ([], 200)


def test_mixture_of_awkward_rows(spark, folder):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    problems, n = compare(spark, db, op7_systematic_mixture, ORACLES["op7_systematic_mixture"], folder)
    assert not problems and n > 130


def test_targets_are_met_and_never_passed(spark):
    rows = [(i, prose(i, 20 + i % 50), "en", ["a", "b", "c", None][min(i % 9, 3)], 1) for i in range(600)]
    got = mixing.mix(frame(spark, rows)).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    for source in taken:
        target = next(r["target"] for r in got if r["source"] == source)
        assert abs(taken[source] - target) < 0.06 * target
    total = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - total) < 1e-6 * total


def test_emitted_copies_and_reruns(spark):
    df = clashing(frame(spark, awkward()))
    first = mixing.emit(df).select("doc_id", "text").collect()
    again = mixing.emit(df.repartition(5)).select("doc_id", "text").collect()
    assert Counter(map(str, first)) == Counter(map(str, again))
    assert mixing.emit(frame(spark, [], SCHEMA)).collect() == []
    assert mixing.targets(frame(spark, [], "source string, size bigint")).collect() == []


def counts_of(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rows = awkward() + [(200 + i, f"# {prose(i, 10)} | b $\n" * (i % 4) + prose(i, 30), "en", "a", 1) for i in range(30)]
    got = quality.with_counts(clashing(frame(spark, rows))).collect()
    for r in got:
        want = counts_of(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def bucket(rate):
    return 0 if rate <= quality.SMALLEST else math.ceil(math.log(rate / quality.SMALLEST) / math.log(quality.GROWTH))


def plain_fences(rows):
    """Group -> rate -> (low, high), from sorted buckets, as the operator's text says."""
    least, levels = quality.LEAST, quality.QUANTILES

    def rates(r):
        per = lambda part, whole, by: by * part / whole if whole else 0.0
        return {"symbols": per(r["n_symbols"], r["n_words"], 100.0), "word_length": per(r["word_chars"], r["n_words"], 1.0), "dup_lines": per(r["n_dup_lines"], r["n_lines"], 100.0), "repeats": per(r["n_repeat_words"], r["n_words"], 100.0)}

    def quantiles(own, rate):
        found = sorted(bucket(rates(r)[rate]) for r in own)
        at = [found[max(math.ceil(len(found) * q), 1) - 1] for q in levels] if found else None
        return len(found), at and [0.0 if b == 0 else quality.SMALLEST * quality.GROWTH ** (b - 0.5) for b in at]

    def drawn(own, wider, rate):
        (n, q), floor = own, least[rate]
        if q is None or wider is None:
            return wider if q is None else q
        out = []
        for level, a, b in zip(levels, q, wider, strict=True):
            beyond = n * min(level, 1 - level)
            w = beyond / (beyond + quality.STRENGTH)
            out.append(math.exp(w * math.log(max(a, floor)) + (1 - w) * math.log(max(b, floor))))
        return out

    good = [r for r in rows if not r["base_failed"]]
    fences = {}
    for group in {(r["lang"], r["source"]) for r in rows}:
        fences[group] = {}
        for rate, floor in least.items():
            whole = quantiles(good, rate)[1]
            wide = drawn(quantiles([r for r in good if r["lang"] == group[0]], rate), whole, rate)
            q = drawn(quantiles([r for r in good if (r["lang"], r["source"]) == group], rate), wide, rate)
            if q is None:
                fences[group][rate] = None
            elif rate == "word_length":
                span = quality.REACH * max(q[2] - q[0], floor)
                fences[group][rate] = (q[0] - span, q[2] + span)
            else:
                tail = [max(x, floor) for x in q[1:]]
                steps = list(zip(tail, tail[1:]))
                jump = next(((a, b) for a, b in steps if b > quality.JUMP * a), None)
                fences[group][rate] = (-1.0, math.sqrt(jump[0] * jump[1]) if jump else tail[-1] * max(b / a for a, b in steps))
    kept = [not r["base_failed"] and all(f is None or f[0] <= v <= f[1] for f, v in zip(fences[r["lang"], r["source"]].values(), rates(r).values())) for r in rows]
    return fences, kept


def test_fences_and_kept_against_plain_version(spark):
    r = random.Random(11)
    rows = []
    for k in range(900):
        words = r.randint(50, 300)
        lines = r.randint(1, 30)
        symbols = r.choice([0, 0, 0, r.randint(0, 4), r.randint(60, 200)]) if r.random() < 0.4 else 0
        row = (k, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", None, f"rare{k}"]), words, words * 5 + r.randint(-60, 60), symbols, r.choice([0, 0, 0, r.randint(0, lines - 1)]), lines, r.choice([0, 0, r.randint(0, words // 5)]), r.random() < 0.1)
        rows.append(row)
    rows.append((901, "xx", "only failed", 0, 0, 0, 0, 0, 0, True))
    names = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint, base_failed boolean"
    counted = spark.createDataFrame(rows, names)
    fences, kept = plain_fences([dict(zip([n.split()[0] for n in names.split(", ")], row, strict=True)) for row in rows])
    name = lambda v: "n" if v is None else "v" + v
    got = {(g["lang"], g["source"]): g["fence"] for g in quality.thresholds(counted).collect()}
    assert set(got) == {(name(a), name(b)) for a, b in fences}
    for (lang, source), own in fences.items():
        for rate, ends in own.items():
            assert tuple(got[name(lang), name(source)][rate]) == pytest.approx(ends), (lang, source, rate)
    judged = {j["doc_id"]: j["kept"] for j in quality.judged(counted, quality.thresholds(counted)).collect()}
    assert judged == {row[0]: k for row, k in zip(rows, kept, strict=True)} and 500 < sum(kept) < 800


def test_sketches_merge_by_adding(spark):
    rows = [(i, " ".join(f"{'w' * (3 + i % 7)}{j}" for j in range(60)), "en", "ab"[i % 2], 1) for i in range(400)]
    sketch = quality.sketches(saved(quality.with_counts(frame(spark, rows)), "counts"))
    merged = {r["rate"]: r["docs"] for r in quality.quantiles(sketch, ["lang"]).collect()}
    parts = Counter()
    for r in quality.quantiles(sketch, ["lang", "source"]).collect():
        parts[r["rate"]] += r["docs"]
    assert merged == dict(parts)


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, prose(i, 60 + i % 40), "en" if i % 2 else None, "ab"[i % 2], 1) for i in range(200)]
    junk = [(500 + i, " ".join(w + "%%%" for w in prose(i, 70).split()), "en", "b", 1) for i in range(12)]
    small = [(600, prose(9, 70), "xx", "rare", 1), (601, " ".join(w + "###" for w in prose(8, 70).split()), "yy", "rare2", 1)]
    counted = saved(quality.with_counts(frame(spark, clean + junk + small)), "counts")
    kept = {r["doc_id"] for r in quality.judged(counted, quality.thresholds(counted)).filter("kept").collect()}
    assert kept == {r[0] for r in clean} | {600}


def test_query_on_awkward_and_empty_tables(spark, folder, tmp_path):
    rows = op3_adaptive_quality(spark, folder).collect()
    assert all(not r["kept"] or not r["base_failed"] for r in rows)
    frame(spark, [], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_adaptive_quality(spark, str(tmp_path)).collect() == []
    assert op7_systematic_mixture(spark, str(tmp_path)).collect() == []
    assert quality.with_counts(frame(spark, awkward())).filter(F.col("text").isNull() & ~F.col("base_failed")).count() == 0


def counted_rows(spark, sources):
    """1,300 texts a source, with so many symbols and characters more; one in fifty repeats lines and words."""
    rows = []
    for source, (symbols, length, tail) in sources.items():
        for i in range(1_300):
            high = tail if i < 26 else 0
            rows.append((len(rows), "en", source, 100, 500 + i % length, i % (symbols + 1), high, 100, high, False))
    names = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint, base_failed boolean"
    return spark.createDataFrame(rows, names), names


def test_each_fence_follows_its_own_group(spark):
    counted, names = counted_rows(spark, {"calm": (1, 40, 14), "lively": (12, 160, 40)})
    limits = {r["source"]: r["fence"] for r in quality.thresholds(counted).collect()}
    for rate in quality.LEAST:
        assert limits["vlively"][rate]["high"] > 1.2 * limits["vcalm"][rate]["high"] > 0, rate
    # one rate of each text is beyond its calm group's fence and within its neighbour's
    probes = [(500, 15, 0, 0), (640, 0, 0, 0), (500, 0, 55, 0), (500, 0, 0, 60)]
    tried = [(i, "en", s, 100, chars, symbols, lines, 100, words, False) for s in ("calm", "lively") for i, (chars, symbols, lines, words) in enumerate(probes)]
    got = quality.judged(spark.createDataFrame(tried, names), quality.thresholds(counted)).collect()
    assert {(r["source"], r["kept"]) for r in got} == {("calm", False), ("lively", True)}


def test_another_kind_of_text_is_cut_off_at_the_jump(spark):
    """One text in fifty has a high rate and none a middling one: the fence stands between, however high the junk is."""
    counted, _ = counted_rows(spark, {"spoilt": (1, 40, 90)})
    fence = quality.thresholds(counted).first()["fence"]
    assert 20 < fence["dup_lines"]["high"] < 90 and 12 < fence["repeats"]["high"] < 90
