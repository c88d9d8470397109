"""Semantics of the engine against brute force in Python and numpy, with extremes and ties."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from vecloom.functions import distance, hashing
from vecloom.functions.embed import embed_batch
from vecloom.model import POINT, Config, Metric, checked, is_valid, row_bytes, stored
from vecloom.operators import filters, ivf, layout, memory, points as log_ops, read, requests, search, sketch
from vecloom.sources.collections import Collections, Conflict
from vecloom.sources.store import Store, digest
from vecloom.sources.vectors import generate, read_fvecs, write_fvecs
from vecloom.streaming import ingest

MAX = float(np.finfo(np.float32).max)
TINY = float(np.float32(1e-45))


def frame(spark, vectors, metadata=None):
    rows = [(i, [float(x) for x in v], (metadata(i) if metadata else {})) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, POINT).repartition(4)


def brute(metric, vectors, query, k, keep=lambda i: True):
    def d(v):
        if metric is Metric.SQUARED_EUCLIDEAN:
            return sum((float(a) - float(b)) ** 2 for a, b in zip(v, query))
        return sum(abs(float(a) - float(b)) for a, b in zip(v, query))

    return sorted((d(v), i) for i, v in enumerate(vectors) if keep(i))[:k]


def found(df):
    return [(r["distance"], r["id"]) for r in df.collect()]


# ---------------------------------------------------------------- exact search
@pytest.mark.parametrize("metric", [Metric.SQUARED_EUCLIDEAN, Metric.MANHATTAN])
def test_grid_every_k(spark, metric):
    vectors = [(float(x), float(y)) for x in range(-3, 4) for y in range(-3, 4)]
    rows = frame(spark, vectors).cache()
    config = Config(2, metric)
    for query in [(0, 0), (-2, 1), (2, 2)]:
        whole = brute(metric, vectors, query, 100)
        for k in (0, 1, 5, 9, 48, 49, 50):
            assert found(search.exact(rows, config, query, k)) == whole[:k]


@pytest.mark.parametrize("metric", [Metric.SQUARED_EUCLIDEAN, Metric.MANHATTAN])
def test_extremes_and_ties(spark, metric):
    special = {0: (0.0, -0.0), 1: (MAX, -MAX), 2: (TINY, 0.0)}
    vectors = [tuple(np.float32(x) for x in special.get(i % 5, (i % 17, -(i % 13)))) for i in range(257)]
    rows = frame(spark, vectors).cache()
    for query in [(0.0, 0.0), (MAX, MAX), (3.0, -4.0)]:
        query = [float(np.float32(x)) for x in query]
        for k in (1, 31, 256, 257, 258):
            assert found(search.exact(rows, Config(2, metric), query, k)) == brute(metric, vectors, query, k)


def test_cosine_is_normalized_and_not_negative(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1000, 1001, (80, 3)).astype(np.float32)
    config = Config(3, Metric.COSINE)
    rows = checked(frame(spark, vectors), config).cache()
    for r in rows.collect():
        assert abs(math.sqrt(sum(float(x) ** 2 for x in r["vector"])) - 1) < 1e-6
    hits = found(search.exact(rows, config, vectors[7], 80))
    assert hits[0][1] == 7 and all(d >= 0 for d, _ in hits) and hits == sorted(hits)
    with pytest.raises(ValueError):
        config.query([0, 0, 0])


def test_query_and_points_are_checked(spark):
    config = Config(2)
    for bad in ([1.0], [1.0, float("nan")], [float("inf"), 0.0]):
        with pytest.raises(ValueError):
            search.exact(frame(spark, [(0, 0)]), config, bad, 0)
        assert not spark.createDataFrame([(bad,)], "v array<float>").select(is_valid(F.col("v"), config)).first()[0]
    with pytest.raises(Exception, match="point refused"):
        checked(frame(spark, [(float("nan"), 1.0)]), config).collect()
    for k in (0, 1001):
        with pytest.raises(ValueError):
            search.knn(frame(spark, [(0, 0)]), config, (0, 0), k)
    with pytest.raises(ValueError):
        Config(2, name="Upper")
    with pytest.raises(ValueError):
        Config(2, routed_keys=("a", "b", "c", "d", "e"))


def test_batch_paths_agree(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 6, (300, 6)).astype(np.float32)
    rows = frame(spark, vectors)
    config = Config(6)
    queries = [(i, vectors[i * 7].tolist()) for i in range(12)]
    table = spark.createDataFrame(queries, "qid long, vector array<float>")
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], r["distance"]) for r in df.collect())
    a, b = key(search.batch_vectors(rows, queries, config, 7)), key(search.batch(rows, table, config, 7))
    assert a == b
    for q, v in queries:
        assert [(d, i) for qid, _, i, d in a if qid == q] == brute(config.metric, vectors, v, 7)


def test_batches_in_blocks(spark, monkeypatch):
    """Several blocks of points and queries, ties and queries that are the same."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (300, 5)).astype(np.float32)
    rows = frame(spark, vectors).cache()
    queries = [(i, vectors[i % 40].tolist()) for i in range(60)]
    table = spark.createDataFrame(queries, "qid long, vector array<float>")
    monkeypatch.setattr(search, "POINTS_AT_ONCE", 70)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 13)
    for metric in (Metric.SQUARED_EUCLIDEAN, Metric.MANHATTAN):
        found_rows = search.batch(rows, table, Config(5, metric), 7, query_block=0).collect()
        for q, v in queries:
            assert [(r["distance"], r["id"]) for r in sorted(found_rows, key=lambda r: r["rank"]) if r["qid"] == q] == brute(metric, vectors, v, 7)
    assert search.batch(rows, table, Config(5), 0, query_block=0).count() == 0
    assert search.batch(rows.limit(0), table, Config(5), 3, query_block=0).count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_nearest_by_bounds_equals_all_distances(metric, monkeypatch):
    """Copies, ties, lengths whose squares cancel, and components that are no numbers; few distances are computed."""
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(6000, 16)).astype(np.float32)
    ties = rng.integers(-2, 3, (3000, 4)).astype(np.float32)
    far = (1e4 + rng.normal(size=(2500, 8)) * 1e-3).astype(np.float32)
    odd = np.where(rng.random((1500, 3)) < 0.3, rng.choice([np.nan, np.inf, -np.inf, MAX, -MAX, TINY], (1500, 3)), rng.normal(size=(1500, 3))).astype(np.float32)
    computed, of_pairs = [], distance.of_pairs
    monkeypatch.setattr(distance, "of_pairs", lambda m, a, b: computed.append(len(a)) or of_pairs(m, a, b))
    with np.errstate(all="ignore"):
        for v in (spread, ties, far, odd, spread[:3], np.repeat(ties[:2], 1500, axis=0)):
            q, ids = v[: len(v) // 5 + 1], rng.permutation(len(v)) * 3
            scores = distance.to_many(metric, v, q)
            for k in (1, 5, 1100):
                computed.clear()
                at, place, got = search.k_nearest(metric, v, ids, q, k)
                for j in range(0, len(q), 7):
                    best = np.lexsort((ids, scores[:, j]))[:k]
                    assert np.array_equal(ids[place[at == j]], ids[best]) and np.array_equal(got[at == j], scores[best, j], equal_nan=True)
                # cosine: these are no unit vectors, so half of the distances are 0
                assert v is not spread or k > 5 or metric is Metric.COSINE or sum(computed) < 0.02 * scores.size


def test_blocks_are_small_and_have_a_task_each(spark):
    """40,000 points and 10,000 queries were one group before, and small groups shared a task."""
    rows = spark.range(40_000).select("id", F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("vector"))
    plan = search.batch(rows, rows.limit(10_000).withColumnRenamed("id", "qid"), Config(2), 3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(p#\d+L, b#\d+L, 6\), REPARTITION_BY_NUM", plan)) == 2


# --------------------------------------------------------------------- filters
SHAPES = [
    {"color": "red"},
    {"color": "blue", "score": {"$gte": 3, "$lt": 12}},
    {"$or": [{"color": "red"}, {"score": {"$gt": 15}}]},
    {"score": {"$exists": False}},
    {"color": {"$ne": "red"}, "cohort": {"$nin": ["no", "maybe"]}},
    {"$and": [{"$or": [{"color": {"$in": ["red", "green"]}}, {"cohort": "yes"}]}]},
    {"$not": {"color": "red"}},
    {},
]


def test_filters_equal_brute_force(spark):
    rng = random.Random(7)
    odd = ["2.5", "NaN", "inf", "+1", "1e5", ".5", "5.", " 2.5 ", "1.5f", "2d", "1_000", "1e400", "", "-3", "0x10", "٣"]
    metadata = {}
    for i in range(200):
        m = {}
        if i % 5:
            m["color"] = rng.choice(["red", "blue", "green"])
        if i % 3:
            m["cohort"] = rng.choice(["yes", "no"])
        if i % 7:
            m["score"] = rng.choice(odd) if i % 4 == 0 else str(i % 20)
        metadata[i] = m
    rows = frame(spark, [(float(i), 0.0) for i in range(200)], metadata.get).cache()
    for shape in SHAPES:
        tree = filters.parse(shape)
        ids = {r["id"] for r in rows.where(filters.on_metadata(shape)).collect()}
        assert ids == {i for i, m in metadata.items() if filters.matches(tree, m)}, shape
        assert found(search.exact(rows, Config(2), (100.0, 0.0), 7, shape)) == brute(Metric.SQUARED_EUCLIDEAN, [(float(i), 0.0) for i in range(200)], (100.0, 0.0), 7, lambda i: filters.matches(tree, metadata[i]))
    numbers = {i for i, m in metadata.items() if m.get("score") in ("2.5", "+1", "1e5", ".5", "5.", "-3")}
    assert numbers <= {r["id"] for r in rows.where(filters.on_metadata({"score": {"$gt": -10}})).collect()}


LEAF = st.one_of(
    st.sampled_from(["a", "b"]),
    st.builds(lambda op, v: {op: v}, st.sampled_from(["$eq", "$ne"]), st.sampled_from(["1", "2", "x"])),
    st.builds(lambda op, v: {op: v}, st.sampled_from(["$in", "$nin"]), st.lists(st.sampled_from(["1", "2", "x"]), max_size=2)),
    st.builds(lambda op, v: {op: v}, st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), st.sampled_from([-1, 0, 1.5, 2])),
    st.builds(lambda v: {"$exists": v}, st.booleans()),
)
TREE = st.recursive(
    st.dictionaries(st.sampled_from(["p", "q"]), LEAF, max_size=2),
    lambda inner: st.one_of(st.builds(lambda k, v: {k: v}, st.sampled_from(["$and", "$or"]), st.lists(inner, max_size=2)), st.builds(lambda v: {"$not": v}, inner)),
    max_leaves=4,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(source=TREE)
def test_random_filters(spark, source):
    if "table" not in _CACHE:
        values = [None, "1", "2", "x", "1.5f", "a"]
        metadata = [{k: v for k, v in (("p", p), ("q", q)) if v is not None} for p in values for q in values]
        _CACHE["metadata"], _CACHE["table"] = metadata, frame(spark, [(0.0, 0.0)] * len(metadata), lambda i: metadata[i]).cache()
    tree = filters.parse(source)
    ids = {r["id"] for r in _CACHE["table"].where(filters.on_metadata(source)).collect()}
    assert ids == {i for i, m in enumerate(_CACHE["metadata"]) if filters.matches(tree, m)}


_CACHE: dict = {}


def nested(n):
    out = {"a": "b"}
    for _ in range(n):
        out = {"$not": out}
    return out


@pytest.mark.parametrize("bad", [{"a": None}, {"$x": []}, {"$and": {}}, {"a": {}}, {"a": {"$eq": 1}}, {"a": {"$gt": "1"}}, {"a": {"$gt": True}}, {"a": {"$in": "x"}}, {"a": {"$zz": 1}}, nested(9), {"$or": [{f"k{i}": "v"} for i in range(65)]}, {"a": {"$in": ["x"] * 1025}}, [], {"a": {"$gt": float("nan")}}])
def test_rejected_filters(bad):
    with pytest.raises(filters.FilterError):
        filters.parse(bad)


def test_accepted_limits_and_equalities():
    filters.parse(nested(8))
    filters.parse({"$or": [{f"k{i}": "v"} for i in range(64)]})
    filters.parse({"a": {"$in": ["x"] * 1024}})
    tree = filters.parse({"a": "1", "$and": [{"b": "2"}, {"$or": [{"c": "3"}]}]})
    assert filters.required_equalities(tree) == [("a", "1"), ("b", "2")] and filters.equality_pairs(tree) is None
    assert filters.equality_pairs(filters.parse({"a": "1", "$and": [{"a": "1"}]})) == [("a", "1"), ("a", "1")]
    assert filters.only_equality(filters.parse({"a": "1", "$and": [{"a": "1"}]}), "a", "1")
    assert not filters.only_equality(filters.parse({}), "a", "1")


# --------------------------------------------------------------- scans and gets
def test_paging_equals_the_full_list(spark):
    rows = frame(spark, [(float(i), 1.0) for i in range(121)], lambda i: {"color": "blue" if i % 3 == 0 else "red"})
    blue = [i for i in range(121) if i % 3 == 0]
    seen = [r["id"] for page in read.pages(rows, {"color": "blue"}, 7) for r in page.collect()]
    assert seen == blue
    assert read.scan(rows, {"color": "blue"}, limit=len(blue)).summary.first().asDict() == {"matched": len(blue), "next": None}
    assert read.scan(rows, {"color": "blue"}, after=60, limit=5).summary.first().asDict() == {"matched": len(blue), "next": 75}
    got = sorted(read.batch_get(rows, [5, 999, 5, 0]).collect(), key=lambda r: r["pos"])
    assert [(r["id"], r["found"]) for r in got] == [(5, True), (999, False), (5, True), (0, True)]
    with pytest.raises(ValueError):
        read.batch_get(rows, [])
    with pytest.raises(ValueError):
        read.scan(rows, limit=0)


# ------------------------------------------------------------------ mutations
def replay(history):
    state = {}
    for seq in sorted(history):
        for m in history[seq]:
            if m[0] == "put":
                state[m[1]] = (list(m[2]), m[3])
            else:
                state.pop(m[1], None)
    return state


def as_state(df):
    return {r["id"]: (list(r["vector"]), dict(r["metadata"])) for r in df.collect()}


def random_history(seed, commits=25):
    rng = random.Random(seed)
    return {s: [("put", rng.randrange(12), [float(s), float(i)], {"v": str(s)}) if rng.random() < 0.7 else ("delete", rng.randrange(12)) for i in range(rng.randrange(1, 5))] for s in range(1, commits)}


def test_live_equals_replay(spark):
    history = random_history(1)
    log = None
    for s, m in history.items():
        log = log_ops.batch(spark, s, m) if log is None else log.unionByName(log_ops.batch(spark, s, m))
    log = log.cache()
    assert as_state(log_ops.live(log)) == replay(history)
    for cut in (5, 12):
        early = {s: m for s, m in history.items() if s <= cut}
        assert as_state(log_ops.live(log, cut)) == replay(early)
        assert as_state(log_ops.live_over(log_ops.live(log, cut), log.where(F.col("seq") > cut))) == replay(history)
    with pytest.raises(ValueError):
        log_ops.batch(spark, 1, [])
    with pytest.raises(ValueError):
        log_ops.write_batch(spark, 1, deletes=range(101))
    last = log_ops.write_batch(spark, 1, [(1, [0.0, 0.0], {})], [1])
    assert log_ops.live(last).count() == 0
    with pytest.raises(ValueError):
        log_ops.delete_by_filter(log_ops.live(log), {}, 1)


def test_store_keeps_state_through_maintenance(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(2))
    history = random_history(2, 14)
    for s, m in history.items():
        assert store.commit(log_ops.batch(spark, 0, m)) == s
        if s == 4:
            store.seal()
        if s == 7:
            store.seal()
            store.consolidate()
        if s == 10:
            view = store.checkpoint()
            pinned, at = store.live(view), replay({k: v for k, v in history.items() if k <= 10})
        assert as_state(store.live()) == replay({k: v for k, v in history.items() if k <= s})
    assert store.checkpoint().sealed == 13 and store.checkpoint() == store.manifest()
    store.cleanup(pinned=(view,))
    assert as_state(pinned) == at
    before = digest(store.live())
    store.compact()
    assert digest(store.live()) == before and store.tail() == []
    assert store.backup(f"file://{tmp_path}/copy") == before[0]
    assert digest(Store(spark, f"file://{tmp_path}/copy", Config(2)).live()) == before
    with pytest.raises(FileExistsError):
        store.commit(log_ops.batch(spark, 0, history[1]), seq=5)
    with pytest.raises(FileExistsError):
        store.files.create(f"manifest/{store.manifest().version:020d}.json", "{}")
    assert store.status()["live"] == before[0]


def put_of(spark, *ids, x=0.0):
    return log_ops.batch(spark, 0, [("put", i, [x, x], {}) for i in ids])


def test_a_view_stays_as_it_was(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(2))
    for i in range(1, 6):
        store.commit(put_of(spark, i))
    view, lone, held = store.view(), store.view(), store.manifest()
    name = store.pin(view)
    assert [r["id"] for r in store.live(store.view(3)).orderBy("id").collect()] == [1, 2, 3]
    store.commit(put_of(spark, 9))
    store.commit(log_ops.batch(spark, 0, [("delete", 1)]))
    assert view.sequence == 5 and set(as_state(store.live(view))) == {1, 2, 3, 4, 5}
    store.seal()
    store.compact()
    assert set(as_state(store.live(view))) == {1, 2, 3, 4, 5} and set(as_state(store.live())) == {2, 3, 4, 5, 9}
    store.unpin(name)
    store.cleanup()
    for state in (lone, held):  # an older state raises; it never reads fewer rows
        with pytest.raises(ValueError, match="gone"):
            store.live(state)
    short = store.pin(store.view(), seconds=-1)
    assert store.pins() == [] and f"{short}.json" not in store.files.names("pins")


def test_commits_count_when_they_are_published(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, f"file://{tmp_path}/s", Config(2)) for _ in range(2))
    store.commit(put_of(spark, 1))
    # a writer that dies after writing its data leaves nothing that counts
    with monkeypatch.context() as m:
        m.setattr(store.files, "create", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.commit(put_of(spark, 2))
    assert set(as_state(store.live())) == {1} and store.sequence() == 1 and len(store.files.names("commits")) == 2
    # of two writers of one number the second fails and takes its data away
    tail = store.tail()
    with monkeypatch.context() as m:
        m.setattr(other, "tail", lambda *_: tail)
        assert store.commit(put_of(spark, 3)) == 2
        with pytest.raises(FileExistsError):
            other.commit(put_of(spark, 4))
    assert set(as_state(store.live())) == {1, 3} and len(store.files.names("commits")) == 3
    store.compact()
    assert store.files.names("commits") == [] and set(as_state(store.live())) == {1, 3}
    other.take_over()
    with pytest.raises(PermissionError):
        store.commit(put_of(spark, 5))
    assert other.commit(put_of(spark, 6)) == 3


def test_restore(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(2))
    for i in range(3):
        store.commit(put_of(spark, i, x=float(i)))
    store.backup(f"file://{tmp_path}/b")
    store.commit(put_of(spark, 7))
    again = Store(spark, f"file://{tmp_path}/r", Config(2))
    assert again.restore(f"file://{tmp_path}/b") == 3
    assert digest(again.live()) == digest(store.live(store.view(3))) and again.commit(put_of(spark, 8)) == 4
    with pytest.raises(FileExistsError):
        again.restore(f"file://{tmp_path}/b")
    with pytest.raises(FileNotFoundError):
        Store(spark, f"file://{tmp_path}/x", Config(2)).restore(f"file://{tmp_path}/nothing")


def test_late_versions_do_not_overwrite(spark, tmp_path):
    """Files out of order: each run ingests one, the oldest version last."""
    history, log_dir = random_history(5, 9), tmp_path / "log"
    store = Store(spark, f"file://{tmp_path}/store", Config(2))
    for i, s in enumerate([3, 1, 5, 4, 8, 2, 7, 6]):
        log_ops.batch(spark, s, history[s]).coalesce(1).write.parquet(str(log_dir / f"{i:05d}"))
        ingest.ingest(ingest.log_stream(spark, str(log_dir)), store, str(tmp_path / "c")).awaitTermination(120)
    assert as_state(store.live()) == replay(history)


def test_collections(spark, tmp_path):
    c = Collections(spark, f"file://{tmp_path}")
    config = Config(3, Metric.COSINE, "one", ("a", "b"), ("k",))
    assert c.create(config)["generation"] == 1 and c.create(config)["generation"] == 1
    with pytest.raises(Conflict):
        c.create(Config(4, Metric.COSINE, "one"))
    store = c.open("one")
    store.commit(log_ops.batch(spark, 0, [("put", 1, [1.0, 0.0, 0.0], {})]))
    assert c.delete("one") and not c.delete("one") and c.get("one") is None and c.names() == []
    assert c.create(config)["generation"] == 2 and c.open("one").live().count() == 0
    assert c.sweep() == ["data/one/1"]
    assert c.table().count() == 1


def test_stream_equals_batch(spark, tmp_path):
    history = random_history(3, 9)
    log_dir = tmp_path / "log"
    for s, m in history.items():
        log_ops.batch(spark, s, m).coalesce(1).write.parquet(str(log_dir / f"{s:05d}"))
    stream = ingest.log_stream(spark, str(log_dir))
    query = ingest.latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert as_state(spark.table("latest").where("op = 'put'")) == replay(history)
    store = Store(spark, f"file://{tmp_path}/store", Config(2))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.log_stream(spark, str(log_dir)), store, str(tmp_path / "c2")).awaitTermination(120)
    assert as_state(store.live()) == replay(history)


# -------------------------------------------------------------------- requests
def put(i, x=0.0):
    return ("put", i, (x,), ())


def test_retry_and_conditions():
    w = requests.Window()
    first = requests.Request(0, "a", (put(1),))
    outcome, applied = w.apply(first)
    assert (outcome.seq, applied) == (1, True)
    w.commit([1])
    assert w.apply(first) == (outcome, False)
    with pytest.raises(requests.RequestError):
        w.apply(requests.Request(0, "a", (put(1, 9.0),)))
    stale = w.apply(requests.Request(2, "b", (put(1),), ((1, 1),)))
    assert stale[0].conflict == "stale_revision" and not stale[1] and w.seq == 3
    good = w.apply(requests.Request(3, "c", (put(1),), ((1, 3), (2, 3))))
    assert good[0].conflict is None and good[1]
    with pytest.raises(requests.RequestError):
        w.apply(requests.Request(99, "d", (put(1),)))


def test_requests_in_a_group_see_each_other():
    w = requests.Window()
    revision, (boundary, nonce) = w.observe(1)
    assert (revision, boundary) == (0, 0) and len(nonce) == 32 and nonce != w.observe(1)[1][1]
    first = requests.Request(0, "a", (put(1),))
    found = w.apply_group([first, requests.Request(0, "b", (put(1),), ((1, 0),)), requests.Request(5, "c", (put(2),)), first, requests.Request(2, "d", (put(2),), ((2, 0),))])
    assert [applied for _, applied in found] == [True, False, False, False, True]
    assert [o.seq for o, _ in (found[0], found[1], found[3], found[4])] == [1, 2, 1, 3]
    assert found[1][0].conflict == "stale_revision" and isinstance(found[2][0], requests.RequestError)


def test_retention_boundaries():
    w = requests.Window()
    w.apply(requests.Request(0, "a", (put(1),)))
    while w.seq < 127:
        w.commit([5])
    assert w.lookup(0, "a")[0] is requests.Lookup.RETAINED and w.lookup(0, "z")[0] is requests.Lookup.UNKNOWN
    w.commit([5])
    assert w.seq == 128 and w.lookup(0, "a")[0] is requests.Lookup.RETAINED and w.lookup(0, "z")[0] is requests.Lookup.EXPIRED
    w.commit([5])
    assert w.lookup(0, "a")[0] is requests.Lookup.EXPIRED and w.floor == 1
    with pytest.raises(requests.RequestError):
        w.apply(requests.Request(0, "a", (put(1),)))
    assert w.apply(requests.Request(w.seq, "e", (put(1),), ((1, 0),)))[0].conflict == "expired_revision"
    w.commit(range(12_801))
    assert w.floor == w.seq and not w.changed


def test_lookup_table_equals_window(spark):
    w = requests.Window()
    rng = random.Random(2)
    asked, receipts = [], []
    for i in range(300):
        b = max(0, w.seq - rng.randrange(0, 140))
        if w.lookup(b, f"n{i}")[0] is requests.Lookup.UNKNOWN:
            outcome, _ = w.apply(requests.Request(b, f"n{i}", (put(i),)))
            receipts.append((b, f"n{i}", outcome.seq))
        else:
            w.commit([i])
        asked.append((b, f"n{i}"))
    asked.append((w.seq + 1, "later"))
    table = requests.lookup_all(spark.createDataFrame(asked, "boundary long, nonce string"), spark.createDataFrame(receipts, "boundary long, nonce string, seq long"), w.seq)
    for r in table.collect():
        state, outcome = w.lookup(r["boundary"], r["nonce"])
        assert r["state"] == state.value and r["outcome_seq"] == (outcome.seq if outcome else None)


# ------------------------------------------------------------- index and sketch
@pytest.mark.parametrize("metric", [Metric.SQUARED_EUCLIDEAN, Metric.MANHATTAN, Metric.COSINE])
def test_full_probe_is_exact_and_partial_is_ordered(spark, metric):
    rng = np.random.default_rng(5)
    vectors = (rng.integers(-11, 12, (97, 4)) + 0.5).astype(np.float32)
    config = Config(4, metric)
    rows = checked(frame(spark, vectors, lambda i: {"sel": "y"} if i % 9 == 0 else {}), config).cache()
    index = ivf.build(rows, config, 7, 5)
    again = ivf.build(rows.repartition(3), config, 7, 5)
    assert np.array_equal(index.centers, again.centers)
    exact = found(search.exact(rows, config, vectors[3], 20))
    assert found(ivf.probe(index, vectors[3], 20, 7)) == exact
    partial = found(ivf.probe(index, vectors[3], 20, 2))
    assert partial == sorted(partial)
    want = {"sel": "y"}
    assert len(found(ivf.adaptive(index, vectors[3], 8, 1, want))) == 8
    assert found(ivf.adaptive(index, vectors[3], 100, 1, want)) == found(search.exact(rows, config, vectors[3], 100, want))
    with pytest.raises(ValueError):
        ivf.probe(index, vectors[3], 5, 0)


def test_identical_points_go_to_the_first_center(spark):
    rows = frame(spark, [(1.0, 1.0)] * 9)
    index = ivf.build(rows, Config(2, Metric.MANHATTAN), 9, 5)
    assert {r["cid"] for r in index.assigned.collect()} == {0} and len(index.centers) == 9


def test_pinned_training(spark):
    """Centers of a published recipe, bit for bit."""
    expected = {3: "3730d6e9d2b8a22a4bf7f8162a91956a5d31683a19a681b7fca23b5f12eba97b", 42: "72242320f6f36541f3ccda52d8b6b917d73dc5df4f749734c75a292b08867ae8"}
    for seed, sha in expected.items():
        ids = np.arange(2000)
        data = np.stack([(hashing.priorities(ids * 1000 + d, seed) % 10_000).astype(np.float32) / np.float32(100) for d in range(8)], axis=1)
        table = frame(spark, data)
        sample = ivf.training_sample(table, 512, seed).collect()
        centers = ivf.train_bounded(Metric.SQUARED_EUCLIDEAN, np.array([r["vector"] for r in sample], dtype=np.float32), 16, 2)
        assert hashlib.sha256(centers.astype("<f4").tobytes()).hexdigest() == sha


@pytest.mark.parametrize("clustered,every,probes,recall,short", [(False, 1, 1, 20.42, 0), (False, 1, 4, 57.50, 0), (True, 1, 1, 100.0, 0), (False, 8, 1, 18.33, 24), (False, 32, 4, 37.08, 24)])
def test_published_recall(spark, clustered, every, probes, recall, short):
    key = ("published", clustered, every)
    if key not in _CACHE:
        rows = generate(spark, 512, 64, 42, clustered).withColumn("metadata", F.when(F.col("id") % every == 0, F.create_map(F.lit("selected"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))).cache()
        _CACHE[key] = ivf.build(rows, Config(64), 16, 8)
    index = _CACHE[key]
    q = hashing.uniform_vectors(42 ^ 0xD1B54A32D192ED03, 24, 64)
    if clustered:
        middle = hashing.uniform_vectors(42 ^ 0xA0761D6478BD642F, 16, 64)
        q = middle[np.arange(24) % 16] + q * np.float32(0.1)
    rows = index.assigned.where(filters.on_metadata({"selected": "true"})).toPandas()
    vectors = np.stack(rows["vector"].to_numpy())
    scores, hits, few = distance.to_many(Metric.SQUARED_EUCLIDEAN, vectors, q), 0.0, 0
    for j in range(24):
        order = np.lexsort((rows["id"], scores[:, j]))
        exact = set(rows["id"].to_numpy()[order[:10]])
        chosen = [c for c, _ in ivf.nearest_centers(Metric.SQUARED_EUCLIDEAN, q[j], index.centers, probes)]
        own = [i for i in order if rows["cid"].iloc[i] in chosen][:10]
        hits += len({rows["id"].iloc[i] for i in own} & exact) / len(exact)
        few += len(own) < 10
    assert round(100 * hits / 24, 2) == recall and few == short


def test_farthest_points_of_more_rows_than_the_driver_holds(spark, tmp_path):
    """The farthest rows lie beyond the first 100,000."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from vecloom.plans import catalog

    n = 100_200
    vectors = np.random.default_rng(7).random((n, 64), dtype=np.float32)
    vectors[100_050::30] *= 5
    flat = pa.array(vectors.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(0, n * 64 + 1, 64), pa.int32()), flat), "label": pa.array(np.arange(n) % 10, pa.int32())}), tmp_path / "embeddings.parquet")
    wanted = ivf.farthest_first(Metric.SQUARED_EUCLIDEAN, vectors, 6, 42).tolist()
    assert max(wanted) >= 100_050
    rows = sorted(catalog.QUERIES["farthest_point_init"](spark, str(tmp_path)).collect())
    assert [r["row"] for r in rows] == wanted
    assert ivf.farthest_rows(frame(spark, vectors[:5]), Metric.SQUARED_EUCLIDEAN, 9, 42, str(tmp_path / "few")) == ivf.farthest_first(Metric.SQUARED_EUCLIDEAN, vectors[:5], 9, 42).tolist()


def test_probe_recall_is_that_of_each_querys_own_probe(spark):
    from vecloom.operators import evaluate

    vectors = np.random.default_rng(8).standard_normal((200, 4)).astype(np.float32)
    config, rows = Config(4), frame(spark, vectors).cache()
    index = ivf.build_bounded(rows, config, 5)
    queries = [(i, vectors[i].tolist()) for i in (0, 60, 120)]
    truth = search.batch_vectors(rows, queries, config, 10)
    got = {(r["qid"], r["probes"]): r["hits"] for r in evaluate.probe_recall(truth, index.assigned, ivf.center_ranks(index, queries), 5).collect()}
    assert len(got) == 15
    for qid, v in queries:
        exact = {i for _, i in found(search.exact(rows, config, v, 10))}
        for probes in (1, 2, 5):
            assert got[qid, probes] == len(exact & {i for _, i in found(ivf.probe(index, v, 10, probes))})


def test_saved_index(spark, tmp_path):
    rows = frame(spark, np.random.default_rng(0).random((60, 3)))
    config = Config(3)
    index = ivf.load_or_build(rows, f"file://{tmp_path}", config, 4, 3, sequence=1)
    again = ivf.load_or_build(rows, f"file://{tmp_path}", config, 4, 3, sequence=1)
    assert np.array_equal(index.centers, again.centers) and again.assigned.count() == 60
    assert ivf.identity(config, 1, partitions=4) != ivf.identity(config, 2, partitions=4)
    plan = again.assigned.where(F.col("cid").isin([1]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cid" in plan or "isnotnull(cid" in plan


def test_sketch_routing_is_exact_with_every_block(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 8)).astype(np.float32)
    rows = frame(spark, vectors, lambda i: {"k": str(i % 3)})
    config = Config(8)
    sk = sketch.sketched(sketch.blocks(rows, rows=16, per_pack=5)).cache()
    for filter in (None, {"k": "1"}):
        assert found(sketch.selective(sk, config, vectors[0], 10, 10**6, filter)) == found(search.exact(rows, config, vectors[0], 10, filter))
    bound = {r["pack"]: r["b"] for r in sk.select("pack", sketch.lower_bound(config, vectors[0]).alias("b")).distinct().collect()}
    for r in sk.select("pack", sketch.approximate(config, vectors[0]).alias("d")).collect():
        assert bound[r["pack"]] <= r["d"] * (1 + 1e-9) + 1e-9
    assert max(max(r["codes"]) for r in sk.select("codes").collect()) <= 31


def test_span_choice_respects_the_budget():
    rng = random.Random(1)
    for _ in range(200):
        blocks = [(f"o{rng.randrange(5)}", rng.randrange(0, 50) * 10, 10) for _ in range(20)]
        spans = sketch.choose_spans(blocks, 3, 120)
        assert len(spans) <= 3 and sum(n for *_, n in spans) <= 120
        assert spans[0][0] == blocks[0][0]


def test_routed_codes(spark):
    table = spark.createDataFrame([("b", ["a", "b"]), (None, ["a"]), ("z", ["a"])], "v string, d array<string>")
    assert [r[0] for r in table.select(sketch.routed_code(F.col("v"), F.col("d"))).collect()] == [1, 254, 255]


def test_layout(spark):
    rows = frame(spark, np.random.default_rng(2).random((900, 4))).withColumn("cid", (F.col("id") % 3).cast("int"))
    table = layout.cluster_layout(rows).collect()
    assert sum(r["rows"] for r in table) == 900 and max(r["rows"] for r in table) <= 170
    ids, vectors = np.arange(900), np.random.default_rng(2).random((900, 4)).astype(np.float32)
    leaf = layout.split_local(ids, vectors)
    order = np.random.default_rng(3).permutation(900)
    shuffled = layout.split_local(ids[order], vectors[order])
    assert np.array_equal(shuffled, leaf[order]) and np.bincount(leaf).max() <= 170
    wide = spark.createDataFrame([(c, b, 1, 0, 0) for c, n in enumerate([5, 8, 30, 2]) for b in range(n)], "cid int, block int, rows long, first_id long, last_id long")
    packed = {(r["cid"], r["block"]): r["pack"] for r in layout.packs(wide).collect()}
    assert packed[0, 0] == 0 and packed[1, 0] == 1 and packed[2, 0] == 2 and packed[2, 12] == 3 and packed[3, 0] == packed[2, 29]
    counts = {}
    for pack in packed.values():
        counts[pack] = counts.get(pack, 0) + 1
    assert max(counts.values()) <= 12
    assert layout.conversion_due(250_000, None) and not layout.conversion_due(10, None) and layout.conversion_due(10_000_000, 4)
    assert [hashing.automatic_centroids(n) for n in (1, 4000, 250_000, 10**9)] == [1, 1, 64, 4096]


# ------------------------------------------------------------- memory and files
def test_memory(spark):
    texts = spark.createDataFrame([("s", "the cat sat", "user"), ("s", "the cat sat", "user"), ("s", "stock prices fell", "user"), ("other", "the cat sat", "x")], "scope string, text string, role string")
    points = memory.remember(texts, 64, ["role"]).cache()
    assert {r["id"] for r in points.collect()} == {hashing.memory_id_of(s, t) for s, t in (("s", "the cat sat"), ("s", "stock prices fell"), ("other", "the cat sat"))}
    hits = memory.recall(points, Config(64, Metric.COSINE), "a cat sat down", "s", 5).collect()
    assert hits[0]["text"] == "the cat sat" and hits[0]["tags"] == {"role": "user"} and len(hits) == 2
    assert memory.count(points, "s").first()[0] == 2
    assert log_ops.live_over(points, memory.forget(points, 1, scope="s")).count() == 1
    with pytest.raises(ValueError):
        memory.forget(points, 1)
    with pytest.raises(ValueError):
        memory.check_tags({"scope": "x"})
    for bad in ([], ["x"] * 65, [" "], ["x" * 40_000]):
        with pytest.raises(ValueError):
            embed_batch(bad, 8)


def test_fvecs_round_trip(spark, tmp_path):
    rows = frame(spark, np.random.default_rng(0).random((50, 7)).astype(np.float32))
    path = str(tmp_path / "v.fvecs")
    assert write_fvecs(rows, path) == 50
    back = {r["id"]: list(r["vector"]) for r in read_fvecs(spark, path, 7).collect()}
    assert back == {r["id"]: list(r["vector"]) for r in rows.collect()}


def test_automatic_centroids_as_a_column(spark):
    rows = [0, -5, 1, 3999, 4000, 5656, 5657, 250_000, 10**7, 10**12, *range(1, 200_000, 4871)]
    table = spark.createDataFrame([(n,) for n in rows], "n long").select("n", hashing.automatic_centroids_of(F.col("n")).alias("c"))
    assert all(r["c"] == hashing.automatic_centroids(r["n"]) for r in table.collect())


def test_row_bytes_and_stored(spark):
    r = frame(spark, [(3.0, 4.0)], lambda i: {"é": "ab"}).select(row_bytes(F.col("vector"), F.col("metadata")).alias("n"), stored(F.col("vector"), Config(2, Metric.COSINE)).alias("v")).first()
    assert r["n"] == 17 + 8 + 4 + 8 + 2 + 2 and [round(x, 6) for x in r["v"]] == [0.6, 0.8]


def test_plans_are_the_wanted_ones(spark, sf_dir):
    from vecloom.plans import catalog

    plan = catalog.QUERIES["knn_filter_eq"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.replace("TakeOrdered", "")
    plan = catalog.QUERIES["knn_batch"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan
    plan = catalog.QUERIES["knn_filter_promoted"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "In(key_label" in plan and "EqualTo(key_parity,odd)" in plan
    plan = catalog.QUERIES["ivf_saved_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cid#\d+ IN", plan)
    plan = catalog.QUERIES["knn_k_over_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "TakeOrdered" not in plan


def test_adaptive_assigns_once_a_pass(spark, sf_dir):
    """The tests for null on the partition took a second Python worker in every task."""
    from vecloom.plans import catalog

    plan = catalog.QUERIES["ivf_adaptive"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


@pytest.mark.parametrize("name", ["recall_at_k", "recall_summary"])
def test_recall_searches_once_for_the_truth(spark, sf_dir, name):
    """The truth was searched twice, and the partitions were assigned again by every search."""
    from vecloom.plans import catalog

    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1 and "EvalPython" not in plan


@pytest.mark.parametrize("name", ["recall_at_k", "recall_summary"])
def test_recall_searches_the_partitions_with_the_truth(spark, sf_dir, name, monkeypatch):
    """The rows of the partitions were searched a second time, and the vectors written for it."""
    from vecloom.plans import catalog

    searches, batch = [], search.batch
    monkeypatch.setattr(search, "batch", lambda *a, **b: searches.append(a) or batch(*a, **b))
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(searches) == 1 and not re.search(r"placed-.*embedding|placed-.*vector", plan)


@pytest.mark.parametrize("block", [0, search.QUERY_BLOCK])
def test_recall_within_is_that_of_the_search_itself(spark, block):
    """Copies and ties, parts of no, some, few and all rows, fewer rows than neighbours, an id of two rows."""
    from vecloom.operators import evaluate

    vectors = np.random.default_rng(12).integers(-1, 2, (300, 3)).astype(np.float32)
    config, rows = Config(3), frame(spark, vectors).cache()
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    for points in (rows, rows.where("id < 4")):
        truth = search.batch(points, queries, config, 5, query_block=block).cache()
        for part in ("id < 0", "id % 3 = 0", "id = 7", "true"):
            read = points.where(part)
            searched = evaluate.recall(search.batch(read, queries, config, 5, query_block=block), truth)
            columns = ["qid", "k", "hits", "recall"]
            got = evaluate.recall_within(truth, read.union(read)).select(columns)
            assert got.dtypes == searched.select(columns).dtypes and sorted(got.collect()) == sorted(searched.select(columns).collect())
        assert {r["k"] for r in got.collect()} == {min(5, points.count())}


def test_recall_summary_of_more_queries_than_a_broadcast(spark, tmp_path):
    """The larger tables' path: the blocks were met three times and the partitions assigned in each; checked by brute force."""
    from vecloom.plans import catalog

    n = 20 * (search.QUERY_BLOCK + 3)
    v = np.random.default_rng(11).integers(-1, 2, (n, 64)).astype(np.float32)
    v[n // 2 :] = v[: n - n // 2]  # copies, so that ties are broken by id
    path = str(tmp_path)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": np.arange(n, dtype=np.int32) % 10}), f"{path}/embeddings.parquet")
    summary = catalog.QUERIES["recall_summary"](spark, path)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FlatMap\w*Groups", plan)) == 1 and "EvalPython" not in plan
    cid = {r["id"]: r["cid"] for r in catalog._index(spark, path).assigned.select("id", "cid").collect()}
    probed = np.array([cid[i] < 4 for i in range(n)])
    recalls = []
    for q in v[::20]:
        order = np.argsort(((v - q) ** 2).sum(axis=1), kind="stable")  # whole numbers, so no rounding
        recalls.append(len(set(order[:5]) & set(order[probed[order]][:5])) / 5)
    assert summary.collect() == [(round(float(np.mean(recalls)), 9), sorted(recalls)[-(-len(recalls) // 20) - 1], 0.0)]


# ------------------------------------------- queries that have no SQL, by brute force
def test_span_choice_query(spark, sf_dir):
    from vecloom.plans import catalog, tables

    ranked = [(r["pack"], r["block"]) for r in sorted(catalog.sketch.route(catalog.sketch.sketched(catalog._packed(spark, sf_dir)), tables.L2, tables.vector_of(spark, sf_dir, 9), 60).collect(), key=lambda r: (r["score"], r["pack"], r["block"]))]
    spent, chosen = 0, {}
    for pack, block in ranked:
        held = chosen.get(pack)
        if held is None and len(chosen) == 3:
            continue
        low, high = (block, block + 1) if held is None else (min(held[0], block), max(held[1], block + 1))
        cost = 6000 * ((high - low) - (0 if held is None else held[1] - held[0]))
        if spent + cost <= 40_000:
            chosen[pack], spent = (low, high), spent + cost
    assert {(r["object"], r["start"], r["length"]) for r in catalog.QUERIES["span_choice"](spark, sf_dir).collect()} == {(f"pack-{p:05d}", 6000 * a, 6000 * (b - a)) for p, (a, b) in chosen.items()}


def test_vector_local_layout_query(spark, sf_dir):
    """Every split of every group is checked: sizes, and that the order along the direction of the halves' means is kept."""
    from vecloom.plans import catalog, tables

    vectors = {r["id"]: np.array(r["vector"], dtype=np.float64) for r in tables.points(spark, sf_dir).collect()}
    rows = catalog.QUERIES["vector_local_layout"](spark, sf_dir).collect()
    assert sorted(r["id"] for r in rows) == sorted(vectors) and all(r["seal"] == r["id"] // 512 for r in rows)

    def leaves(ids):
        if len(ids) <= layout.BLOCK_ROWS:
            return [ids]
        count = max(-(-len(ids) // layout.BLOCK_ROWS), 2)
        cut = len(ids) * (count // 2) // count
        x = {i: vectors[i] for i in ids}
        axis = max(range(64), key=lambda d: (sum(v[d] ** 2 for v in x.values()) - sum(v[d] for v in x.values()) ** 2 / len(x), -d))
        order = sorted(ids, key=lambda i: (x[i][axis], i))
        for _ in range(3):
            w = np.mean([x[i] for i in order[cut:]], axis=0) - np.mean([x[i] for i in order[:cut]], axis=0)
            order = sorted(order, key=lambda i: (x[i] @ w, i))
        return leaves(order[:cut]) + leaves(order[cut:])

    for seal in {r["seal"] for r in rows}:
        own = {}
        for r in rows:
            if r["seal"] == seal:
                own.setdefault(r["leaf"], set()).add(r["id"])
        wanted = [set(part) for part in leaves(sorted(i for i in vectors if i // 512 == seal))]
        assert [own[n] for n in sorted(own)] == wanted


def memories(spark, sf_dir):
    from vecloom.functions.embed import embed_text

    found = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null").collect():
        scope = f"conv-{r['conv_id']}"
        found.setdefault((hashing.memory_id_of(scope, r["text"]), scope, r["text"]), set()).add(r["role"])
    return {key: (embed_text(key[2], 64), roles) for key, roles in found.items()}


def cosine(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return max(1.0 - total, 0.0)


def test_memory_recall_query(spark, sf_dir):
    from vecloom.functions.embed import embed_text
    from vecloom.plans import catalog, tables

    q = tables.COSINE.query(embed_text("how are the things", 64))
    ranked = sorted((cosine(v, q), i, text, roles) for (i, scope, text), (v, roles) in memories(spark, sf_dir).items() if scope == "conv-1")[:5]
    rows = sorted(catalog.QUERIES["memory_recall"](spark, sf_dir).collect(), key=lambda r: (-r["score"], r["id"]))
    assert [(r["id"], r["text"]) for r in rows] == [(i, text) for _, i, text, _ in ranked]
    assert all(abs(r["score"] - (1 - d)) < 1e-12 and r["role"] in roles for r, (d, _, _, roles) in zip(rows, ranked))


def test_text_query_query(spark, sf_dir):
    from vecloom.functions.embed import embed_text
    from vecloom.plans import catalog, tables

    q = tables.COSINE.query(embed_text("where is the station", 64))
    ranked = sorted((cosine(v, q), i) for (i, _, _), (v, _) in memories(spark, sf_dir).items())[:10]
    rows = sorted((r["distance"], r["id"]) for r in catalog.QUERIES["text_query"](spark, sf_dir).collect())
    assert [i for _, i in rows] == [i for _, i in ranked] and all(abs(a - b) < 1e-12 for (a, _), (b, _) in zip(rows, ranked))
