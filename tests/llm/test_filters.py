"""Quality bands, exact duplicates, near duplicates and the pipeline, against brute force and on hard inputs."""

import random
import re
from types import SimpleNamespace

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souk.llm import exact, neardup, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "co", "di", "fu", "gé", "lo", "mi", "nü", "pa", "ße"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return " ".join(r.choice(words) for _ in range(n))


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


HARD = [None, "", " \n\t", "x", prose(1, 40), prose(1, 40), "é" * 100_000, prose(2, 30_000), "🙂 " * 5000, "one two three"]


def hard(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like internal ones."""
    d = docs(spark, HARD)
    d = d.union(d.filter("doc_id = 4")).union(spark.createDataFrame([(None, prose(3, 30), None, None, None)], DOCS))
    for c in ("fp", "ratio", "reason", "duplicate_of", "value", "sketch", "tokens", "near_copy", "is_again", "a", "b", "spans", "row"):
        d = d.withColumn(c, F.lit("mine"))
    return d


def test_quality_reasons(spark):
    rng = random.Random(5)
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    texts = [prose(1, 500), "spam " * 500, noise, "short text", None, "", prose(2, 3000) + " buy now" * 3000, prose(4, 20)]
    got = {r.doc_id: r.reason for r in quality.assess(docs(spark, texts)).collect()}
    assert [got[i] for i in range(8)] == [None, "repetitive", "incompressible", None, "empty", "empty", got[6], None]
    assert got[6] in ("repetitive", "repetitive chunks")
    assert sorted(r.doc_id for r in quality.keep(docs(spark, texts)).collect()) == [0, 3, 7]


def test_short_noise_and_short_repetition_are_rejected(spark):
    rng = random.Random(6)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = ["".join(rng.choice(base64) for _ in range(n)) for n in (130, 200, 300, 500, 900) for _ in range(30)]
    repeated = [("buy now! " * 80)[:n] for n in (64, 100, 127, 200, 450)]
    assert quality.keep(docs(spark, noise + repeated)).count() == 0
    text = "The river rose in the night and by morning the lower fields were under water, so the farmer moved the sheep up to the old barn. Nobody in the village could remember a flood this early; the mill had stopped, two bridges were closed and the post came a day late. "
    assert quality.keep(docs(spark, [text[:n] for n in (20, 40, 70, 100, 130, 200, 260)])).count() == 7
    chinese = "人工智能是研究开发用于模拟延伸和扩展人的智能的理论方法技术及应用系统的一门新的技术科学。春天来了，公园里的花都开了，孩子们在草地上奔跑，老人坐在长椅上聊天，远处的山还留着一点残雪，河水慢慢流过小镇，桥边的茶馆坐满了客人。"
    assert quality.keep(docs(spark, [chinese[:n] for n in (20, 40, 60, 90, 105)])).count() == 5


def test_quality_equals_brute_force(spark):
    def brute(text):
        raw = (text or "").encode()
        if not raw.strip():
            return "empty"
        z = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)

        def side(part):
            low, high = [(a, b) for n, a, b in quality.BANDS if len(part) >= n][-1]
            x = len(z.compress(part)) / len(part)
            return "repetitive" if x < low else "incompressible" if x > high else None

        if side(raw) or len(raw) <= 2048:
            return side(raw)
        starts = list(range(0, len(raw) - 2048, 2048)) + [len(raw) - 2048]
        sides = [side(raw[i : i + 2048]) for i in starts]
        for what in ("repetitive", "incompressible"):
            if sides.count(what) >= max(1, 0.2 * len(sides)):
                return f"{what} chunks"
        return None

    texts = [prose(i, n) + " ab" * m for i, (n, m) in enumerate((n, m) for n in (3, 60, 400, 2000) for m in (0, 30, 400, 1500, 4000))]
    got = {r.doc_id: r.reason for r in quality.assess(docs(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 9000))
def test_fingerprints_compose(raw, at):
    at = min(at, len(raw))
    whole = 0
    for b in raw:
        whole = (whole * exact.BASE + b + 1) % exact.P
    assert exact.fingerprint(raw) == whole
    assert exact.fingerprint(raw, chunk=64) == whole
    assert exact.combine(exact.fingerprint(raw[:at]), exact.fingerprint(raw[at:]), len(raw) - at) == whole


def test_exact_pairs_and_kept(spark):
    texts = ["ça", "b", "ça", "", "", None, None, "ça", "b "] + [prose(7, 9000)] * 3
    got = sorted((r.doc_id, r.duplicate_of) for r in exact.duplicates(docs(spark, texts).repartition(5)).collect())
    assert got == [(2, 0), (4, 3), (7, 0), (10, 9), (11, 9)]
    kept = exact.keep(docs(spark, texts).repartition(5))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 5, 6, 8, 9]


def test_copies_of_later_batches_and_columns_without_order(spark):
    """Copies that lie in other batches of a task, in falling and rising ids; maps in whatever nesting."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        texts = [prose(i % 4, 50) for i in range(20)] + ["", None, ""]
        for d in (docs(spark, texts), docs(spark, texts).orderBy(F.desc("doc_id"))):
            d = d.coalesce(1).withColumn("m", F.create_map("lang", "source")).withColumn("am", F.array("m")).withColumn("sm", F.struct(F.struct("am").alias("in")))
            assert sorted((r.doc_id, r.duplicate_of) for r in exact.duplicates(d).collect()) == sorted([(i, i % 4) for i in range(4, 20)] + [(22, 20)])
            kept = exact.keep(d)
            assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 20, 21]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_exact_survives_colliding_fingerprints(spark, monkeypatch):
    """With every fingerprint of a length the same, the comparison alone decides."""
    monkeypatch.setattr(exact, "fingerprint", lambda raw, *_: 7)
    texts = ["aa", "bb", "aa", "é", "cc", "bb"]
    df = docs(spark, texts).coalesce(1)
    assert sorted((r.doc_id, r.duplicate_of) for r in exact.duplicates(df).collect()) == [(2, 0), (5, 1)]


def shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("".join(r.choice("xyzw") for _ in range(5)) if r.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    shared = prose(99, 12)
    texts = [shared + ". " + prose(i, 60 + 7 * i) for i in range(40)]
    texts += [edited(texts[i % 12], 100 + i, 0.02 + 0.02 * (i % 6)) for i in range(80)]
    texts += [texts[0]] * 30 + ["a b", "A, b!", "a", "…", None, ""]
    sets = [shingles(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= neardup.JACCARD]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    got = {r.doc_id: r.duplicate_of for r in neardup.links(docs(spark, texts).repartition(6)).collect()}
    found = [got.get(i, i) for i in range(len(texts))]
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(root(i) == root(j) for i, j in got.items()), "a group holds documents that no chain of near copies joins"
    assert got[121] == 0 and got[151] == 150
    kept = {r.doc_id for r in neardup.keep(docs(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - got.keys()


def test_near_groups_joined_only_across_lists(spark):
    """A chain a - b - c whose ends aren't near: one group, as its links are compared wherever they meet."""
    base = prose(5, 200).split()
    texts = [" ".join(base[i : i + 100]) for i in range(0, 90, 22)]
    got = neardup.links(docs(spark, texts[::-1]))
    assert {(r.doc_id, r.duplicate_of) for r in got.collect()} == {(i, 0) for i in range(1, len(texts))}


def test_near_texts_of_one_id_and_hot_lists(spark, monkeypatch):
    """Two texts under one id join their groups; more comparisons with one text than a task takes; a line in every text."""
    monkeypatch.setattr(neardup, "EACH", 3)
    base = [prose(i, 80) for i in range(4)]
    rows = [(i, "the same line in each of all these texts " + edited(base[i % 4], 300 + i, 0.02)) for i in range(40)] + [(50, base[0]), (50, base[1]), (60, prose(70, 80)), (61, prose(70, 80)), (62, prose(71, 80))]
    got = {r.doc_id: r.duplicate_of for r in neardup.links(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == {i: (2 if i % 4 == 2 else 3 if i % 4 == 3 else 0) for i in range(40) if i not in (0, 2, 3)} | {50: 0, 61: 60}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 8), (4, 4)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.doc_id: r.root for r in neardup.components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}


@pytest.mark.parametrize("op", [quality.keep, exact.keep, neardup.keep])
def test_filters_on_hard_tables(spark, op):
    d = hard(spark)
    out = op(d)
    assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
    ids = [r.doc_id for r in out.collect()]
    if op is quality.keep:
        assert ids.count(4) == 2 and 0 not in ids and 6 not in ids and None in ids and 7 in ids
    elif op is exact.keep:
        assert ids.count(4) == 1 and 5 not in ids and {0, 1, 2, 6, 7, 8, None} <= set(ids)
    else:
        assert 4 in ids and 5 not in ids and {0, 1, 2, 6, 7, 8, None} <= set(ids)
    assert op(d.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(i, 150) for i in range(30)] + [prose(0, 150)] * 5 + [edited(prose(1, 150), 3, 0.03), "buy " * 400, None, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + prose(50, 60)]
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at
    expected = set(range(30)) | {38}
    for name in ("near_dedup", "secret_scan"):
        assert {r.doc_id for r in seen[name].collect()} == expected and seen[name].columns == d.columns
    assert seen["secret_scan"].filter("doc_id = 38 and text like '%[named secret]%' and n_chars = length(text)").count() == 1
    packed = seen["pack_windows"].agg(F.sum("n_tokens").alias("n")).first().n
    assert packed == seen["secret_scan"].agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert corpus_pipeline.run(spark, str(tmp_path)).exceptAll(at).isEmpty()


def test_pipeline_on_empty_and_hard_tables(spark, tmp_path):
    """No rows give no windows; nulls, repeated rows, long texts and clashing columns go through all stages."""
    import corpus_pipeline

    h = hard(spark)
    for name, d in (("empty", h.limit(0)), ("hard", h)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = {}
    for r in corpus_pipeline.run(spark, f"{tmp_path}/hard").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    # 6 and 8 repeat themselves, 0 to 2 are empty, 5 is a copy of 4, whose repeated row is one as well
    assert got == {i: len(HARD[i].split()) for i in (3, 4, 7, 9)} | {None: 30}


def test_tables_are_dropped_and_a_cluster_needs_a_folder(spark):
    from pathlib import Path

    from souk.llm import shared

    t = shared.table(spark.range(3), "t")
    path = Path(t.written_to.removeprefix("file:").replace("//", "/"))
    assert path.is_dir()
    shared.drop(t)
    assert not path.exists()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


def test_shared_folder_is_the_session_setting(spark, tmp_path):
    from souk.llm import shared

    assert shared.shared_dir(spark)
    stub = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: f"file://{tmp_path}/x/" if name == "spark.checkpoint.dir" else default))
    assert shared.shared_dir(stub) == f"file://{tmp_path}/x"
    assert shared.table(spark.range(3), "t").count() == 3
