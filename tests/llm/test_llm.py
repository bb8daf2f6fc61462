"""Training-data operators against brute force, on small fixtures with nulls, ties, repeats and odd columns."""

import random
import re

import numpy as np
import pytest

from cinemill.llm import clusters, leakage, neighbours, packing, pii, queries, ranking, repetition

DIMS = 160


# ---- 1 ------------------------------------------------------------------------------------------


def share(text):
    words = re.findall("[a-z]+", text.lower())
    seen, marked = set(), set()
    for i in range(len(words) - 3):
        gram = tuple(words[i : i + 4])
        marked |= set(range(i, i + 4)) if gram in seen else set()
        seen.add(gram)
    return len(words), len(marked)


def random_text(rng, n, share_):
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.choice([1, 2, 4, 9]))) for _ in range(400)]
    words = rng.choices(vocabulary, k=n)
    while rng.random() < share_ and n > 8:
        a, b, k = rng.randrange(n - 4), rng.randrange(n - 4), rng.randrange(4, 9)
        words[b : b + k] = words[a : a + k]
    return " ".join(words)


def test_repetition_bands_lose_nothing():
    import zstandard

    rng, p = random.Random(0), repetition.Bands()
    packers = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=19)
    found = 0
    for _ in range(1500):
        text = random_text(rng, rng.choice([11, 12, 13, 20, 26, 60, 120, 700]), 0.9)
        n, repeated = share(text)
        got = repetition.measure_text(text, p, packers)
        assert got[-1] == (n >= 12 and 20 * repeated >= 7 * n)
        found += got[-1]
        assert got[-3] is None or got[-3] == repeated
    assert found > 100


def test_repetition_share_of_every_text():
    import zstandard

    rng, p = random.Random(3), repetition.Bands()
    packers = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=19)
    low = 0
    for text in [random_text(rng, n, 0.5) for n in (3, 8, 11, 12, 60, 120, 700) * 30] + ["", "?!", "a b c d a b c d"]:
        n, repeated = share(text)
        got = repetition.measure_text(text, p, packers)
        assert got[-3:-1] == (repeated, repeated / n if n else 0.0)
        low += 0 < 20 * repeated < 7 * n
    assert low > 20


def test_repetition_odd_rows(spark):
    long = "the same words come again " * 60_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two", None), (4, long, "x"), (4, long, "x")], "n_words long, text string, band string")
    rows = repetition.compression_bands(df, ["n_words"], "text").collect()
    assert [(r.n_words, r.n_words_, r.repetitive) for r in rows] == [(1, 0, False), (2, 0, False), (3, 2, False), (4, 300_000, True), (4, 300_000, True)]
    assert repetition.compression_bands(df.limit(0), ["n_words"], "text").count() == 0


# ---- 2 ------------------------------------------------------------------------------------------


def vector_table(spark, x, extra=()):
    rows = [(1, i, [float(v) for v in row], "e") for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "video long, key long, vector array<double>, cosine string")


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((120, DIMS))
    x = centres[rng.integers(0, 120, 2500)] + 0.8 * rng.standard_normal((2500, DIMS))
    x[5] = x[4]
    odd = [(1, 9000, None, ""), (1, 9001, [0.0] * DIMS, ""), (1, 9002, [1.0] * 7, ""), (1, 9003, [float("nan")] * DIMS, ""), (1, 4, [float(v) for v in x[4]], "again")]
    df = vector_table(spark, x, odd)
    index = neighbours.Index(cell=60, tile=150)
    got = neighbours.nearest(df, ["video", "key"], "vector", k=5, index=index).collect()
    by = {}
    for r in got:
        by.setdefault(r.q.key, {})[r.n.key] = r.cosine
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum(j in by[i] for i in range(2500) for j in want[i]) / 12500 >= 0.9
    assert by[4][5] > 0.999 and all(k < 9000 and len(v) <= 5 for k, v in by.items())
    assert max(abs(c - s[i, j]) for i, v in by.items() for j, c in v.items()) < 0.01
    exact = {(r.q.key, r.n.key): r.cosine for r in neighbours.exact_cosines(neighbours.nearest(df, ["video", "key"], "vector", least=0.9, index=index), df, ["video", "key"], "vector").collect()}
    assert all(abs(c - s[i, j]) < 1e-9 for (i, j), c in exact.items())
    assert neighbours.nearest(df.limit(0), ["video", "key"], "vector").count() == 0
    assert neighbours.nearest(df.filter("key = 7"), ["video", "key"], "vector").count() == 0


def test_knn_recall_of_spread_vectors(spark, tmp_path):
    """Vectors without close partners, as most are: p2_knn still has nine tenths of the five nearest."""
    x = np.random.default_rng(8).standard_normal((4000, DIMS))
    rows = [(1, i, [float(z) for z in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "video_id long, event_id long, event_embedding array<float>").write.parquet(f"{tmp_path}/video_event.parquet")
    spark.createDataFrame([(1, 0.0, None)], "video_id long, timestamp_ms double, multimodal_embedding array<float>").write.parquet(f"{tmp_path}/temporal_feature.parquet")
    got = {(r.item_key, r.near_key) for r in queries.p2_knn(spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert sum((i, j) in got for i in range(4000) for j in want[i]) / 20_000 >= 0.9


def test_neighbours_recall_beyond_the_most_cells(spark):
    """With few cells allowed, cells are large and are searched by parts: recall stays, and so does what is shuffled."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, DIMS))
    x = centres[rng.integers(0, 60, 6000)] + 1.2 * rng.standard_normal((6000, DIMS))
    index = neighbours.Index(cell=100, most_cells=6, probes=4, tile=500, part=300, part_probes=3)
    got = {}
    for r in neighbours.nearest(vector_table(spark, x), ["video", "key"], "vector", index=index).collect():
        got.setdefault(r.q.key, set()).add(r.n.key)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    assert all(len(got[i]) == 5 and i not in got[i] for i in range(6000))
    assert sum(j in got[i] for i in range(6000) for j in want[i]) / 30_000 >= 0.9


@pytest.mark.parametrize("sample", [50, 1])
def test_neighbours_few_usable(spark, sample):
    """A large table of which few rows are usable keeps all their neighbours, also where chance leaves the sample empty."""
    x = np.random.default_rng(6).standard_normal((12, DIMS))
    odd = [(1, 100 + i, None if i % 2 else [0.0] * DIMS, "") for i in range(3000)]
    got = neighbours.nearest(vector_table(spark, x, odd), ["video", "key"], "vector", index=neighbours.Index(sample=sample, seed=0)).collect()
    assert {(r.q.key, sum(o.q.key == r.q.key for o in got)) for r in got} == {(i, 5) for i in range(12)}


def test_neighbours_hot_copies(spark):
    """A third of all rows is one vector: its copies find each other, and others find the first of them."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, DIMS))
    x[300:600] = x[300]
    x[0] = x[300] + 0.05 * rng.standard_normal(DIMS)
    got = neighbours.nearest(vector_table(spark, x), ["video", "key"], "vector", least=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r.q.key, set()).add(r.n.key)
    assert len(by[0]) == 5 and by[0] <= {300, 301, 302, 303, 304, 305} and by[599] == {300, 301, 302, 303, 304}
    assert all(len(by[i]) == 5 and all(300 <= j < 600 or j == 0 for j in by[i]) for i in range(300, 600))


# ---- 3 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [100_000, 150])
def test_vector_clusters(spark, tile):
    """The same clusters whole, cut by planes, and dealt out over tiles of a dense part."""
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.standard_normal((DIMS, 12)))[0].T
    sizes = [500, 200, *[30] * 8, 2, 1]
    rows, want = [], {}
    for c, n in enumerate(sizes):
        for i in range(n):
            v = centres[c] + 0.3 * rng.standard_normal(DIMS) / np.sqrt(DIMS) * 1.5
            rows.append((1, f"{c:02d}-{i:03d}", [float(z) for z in 3 * v], c))
            want[1, f"{c:02d}-{i:03d}"] = f"{c:02d}-000"
    rows += [(None, "a", rows[0][2], 0), (None, "b", rows[1][2], 0), (1, "zz", None, 0), (1, None, rows[0][2], 0), (1, "zero", [0.0] * DIMS, 0), rows[3]]
    want |= {(None, "a"): "a", (None, "b"): "a"}
    df = spark.createDataFrame(rows, "video long, key string, face array<double>, size int")
    got = clusters.vector_clusters(df, "video", "key", "face", params=clusters.Density(tile=tile, sample=400, shared=60)).collect()
    assert {(r.video, r.member): r.cluster_key for r in got} == want
    size = {(r.video, r.cluster_key): r.cluster_size for r in got}
    assert size[1, "00-000"] == 500 and size[1, "11-000"] == 1
    assert len({r.cluster_key for r in got if r.typical and r.video == 1}) == 12 == sum(r.typical for r in got if r.video == 1)


def test_vector_clusters_dense_tiles(spark):
    """A dense part over tiles: faces that hang on one outlier of a group, pairs and lone faces come out as by brute force."""
    rng = np.random.default_rng(5)
    frames = np.linalg.qr(rng.standard_normal((DIMS, DIMS)))[0].T
    p = clusters.Density(tile=300, sample=400, shared=4, reduced=1)
    noise = lambda n: 0.2 * rng.standard_normal((n, DIMS)) / np.sqrt(DIMS)
    groups = np.concatenate([frames[c] + noise(100) for c in range(8)])
    outliers = 0.75 * frames[:8] + 0.66 * frames[8:16]
    hanging = 0.75 * outliers + 0.66 * frames[16:24]
    pairs = np.repeat(frames[24:84], 2, axis=0) + noise(120)
    x = np.concatenate([groups, pairs, frames[84:112], outliers, hanging])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"{i:04d}" for i in range(len(x))]
    label = clusters.linked_components(x, p.link)
    least = {c: min(n for n, k in zip(names, label) if k == c) for c in set(label)}
    want = {n: least[c] if c >= 0 else n for n, c in zip(names, label)}
    assert len(set(want.values())) == 8 + 60 + 28
    df = spark.createDataFrame([(7, n, [float(z) for z in v]) for n, v in zip(names, x)], "video long, key string, face array<double>")
    got = clusters.vector_clusters(df, "video", "key", "face", params=p).collect()
    assert {r.member: r.cluster_key for r in got} == want and len(got) == len(x)
    joined = {r.member: r.typicality for r in got if r.cluster_size == 2}
    assert len(joined) == 120 and max(joined.values()) < 0.9999


def dbscan(x, names, link, least):
    """Cluster keys by brute force: linked core points, border points with the smallest key, others alone."""
    linked = x @ x.T >= link
    core = linked.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            front = [i]
            while front:
                j = front.pop()
                if label[j] < 0:
                    label[j] = i
                    front += [int(k) for k in np.flatnonzero(linked[j] & core & (label < 0))]
    reach = [{label[j] for j in np.flatnonzero(linked[i] & core)} for i in range(len(x))]
    first = {}
    for n, r in zip(names, reach):
        for c in r:
            first[c] = min(n, first.get(c, n))
    where = [min(r, key=first.get) if r else None for r in reach]
    key = {}
    for n, c in zip(names, where):
        if c is not None:
            key[c] = min(n, key.get(c, n))
    return {n: key[c] if c is not None else n for n, c in zip(names, where)}


@pytest.mark.parametrize("least", [2, 4])
def test_density_with_core_and_border_points(spark, least):
    """Dense groups, a chain, border points and noise in a space of many tiles are those of brute force."""
    rng = np.random.default_rng(12)
    frames = np.linalg.qr(rng.standard_normal((DIMS, DIMS)))[0].T
    noise = lambda n, s: s * rng.standard_normal((n, DIMS)) / np.sqrt(DIMS)
    dense = np.concatenate([frames[c] + noise(n, 0.45) for c, n in enumerate((1300, 300, 250, 40, 4, 3, 2))])
    steps = np.linspace(0, np.pi / 2, 25)
    chain = np.concatenate([np.outer(np.cos(steps), frames[20 + k]) + np.outer(np.sin(steps), frames[21 + k]) for k in range(4)]) + noise(100, 0.5)
    border = 0.62 * frames[:3] + 0.78 * frames[60:63] + noise(3, 0.1)
    between = (frames[1] + frames[2])[None] / np.sqrt(2) + noise(1, 0.05)
    x = np.concatenate([dense, chain, border, between, rng.standard_normal((60, DIMS))])
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127)  # as the operator keeps them
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    names = [f"{i:05d}" for i in rng.permutation(len(x))]
    p = clusters.Density(link=0.65, min_points=least, tile=500, sample=600, shared=20, cells=4)
    df = spark.createDataFrame([(7, n, [float(z) for z in v]) for n, v in zip(names, x)], "video long, key string, face array<double>")
    want = dbscan(u, names, p.link, least)
    for broadcast in (p.most_broadcast, 0):
        how = clusters.Density(**{**p.__dict__, "most_broadcast": broadcast})
        got = clusters.vector_clusters(df, "video", "key", "face", params=how).collect()
        assert {r.member: r.cluster_key for r in got} == want and len(got) == len(x)
    at = {n: i for i, n in enumerate(names)}
    for key in {r.cluster_key for r in got if r.cluster_size > 3}:
        own = sorted(r.member for r in got if r.cluster_key == key)
        mean = (u[[at[n] for n in own]] @ u[[at[n] for n in own]].T).mean(1)
        mine = sorted((r for r in got if r.cluster_key == key and r.typical_place), key=lambda r: r.typical_place)
        assert len(mine) == 3 and [r.typical for r in mine] == [True, False, False]
        best = np.sort(mean)[::-1]
        assert all(abs(r.typicality - mean[own.index(r.member)]) < 1e-3 and r.typicality >= best[k] - 1e-3 for k, r in enumerate(mine))


def shuffled_rows(spark, work):
    """Rows that the stages of ``work`` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        kept = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return [(kept.apply(i).stageId(), kept.apply(i).shuffleWriteRecords()) for i in range(kept.size())]

    last = max((i for i, _ in stages()), default=-1)
    out = work()
    return out, sum(n for i, n in stages() if i > last)


def test_shuffles_grow_with_the_space(spark):
    """Four times the faces of the same people, many in no cell, in four times the tiles: well under the 16 times of all pairs."""
    rng = np.random.default_rng(21)
    frames = np.linalg.qr(rng.standard_normal((DIMS, 4)))[0].T
    p = clusters.Density(tile=100, sample=500, shared=10)
    written = []
    for n in (1000, 4000):
        who = np.arange(n) % 4
        x = frames[who] + rng.choice([0.5, 0.7, 0.85], (n, 1), p=[0.7, 0.2, 0.1]) * rng.standard_normal((n, DIMS)) / np.sqrt(DIMS)
        x[: n // 50] = rng.standard_normal((n // 50, DIMS))
        x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127)  # as the operator keeps them
        names = [f"{i:05d}" for i in range(n)]
        df = spark.createDataFrame([(7, m, [float(z) for z in v]) for m, v in zip(names, x)], "video long, key string, face array<double>")
        got, rows = shuffled_rows(spark, lambda: clusters.vector_clusters(df, "video", "key", "face", params=p, describe=False).collect())
        u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        assert {r.member: r.cluster_key for r in got} == dbscan(u, names, p.link, p.min_points)
        written.append(rows)
    assert 0 < written[1] < 10 * written[0], written


def test_rows_in_no_cell_meet_their_clusters(spark):
    """People without a cell of their own, over several tiles: four times the faces don't shuffle the 16 times of their pairs."""
    rng = np.random.default_rng(23)
    frames = np.linalg.qr(rng.standard_normal((DIMS, 6)))[0].T
    p = clusters.Density(tile=300, sample=500, shared=10, cells=2)
    written = []
    for n in (750, 3000):
        x = frames[np.arange(n) % 6] + 0.5 * rng.standard_normal((n, DIMS)) / np.sqrt(DIMS)
        x[: n // 50] = rng.standard_normal((n // 50, DIMS))
        x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127)  # as the operator keeps them
        names = [f"{i:05d}" for i in range(n)]
        df = spark.createDataFrame([(7, m, [float(z) for z in v]) for m, v in zip(names, x)], "video long, key string, face array<double>")
        got, rows = shuffled_rows(spark, lambda: clusters.vector_clusters(df, "video", "key", "face", params=p, describe=False).collect())
        u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        assert {r.member: r.cluster_key for r in got} == dbscan(u, names, p.link, p.min_points)
        written.append(rows)
    assert 0 < written[1] < 8 * written[0], written


def test_marks_meet_wherever_slips_allow():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choices("abcde", k=rng.choice([4, 5, 7, 12, 14, 15, 16, 17, 18, 19, 30, 60])))
        b = list(a)
        for _ in range(rng.choice([1, 2, 2])):
            i = rng.randrange(len(b))
            kind = rng.randrange(4)
            if kind == 0:
                b.insert(i, rng.choice("abcde"))
            elif kind == 1 and len(b) > 1:
                del b[i]
            elif kind == 2:
                b[i] = rng.choice("abcde")
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        b = "".join(b)
        if clusters.slips(a, b, 2):
            assert clusters.marks(a, 2) & clusters.marks(b, 2)
    assert len(clusters.marks("x" * 5000, 2)) < 200


def test_spelling_clusters(spark):
    groups = [["Person 27", "PERSON 27", "Person_27", '"Person 27"', "Person 27 (voice)", "[Person 27]"], ["Person 28"], ["Person B", "person b."], ["Person A"]]
    groups += [["Hunnaelgra", "Hnunaelgra", "hunnaaelgra", "HUNNAELGRA (off)", "Hunnelgra"], ["Starvtrivuk", "Strvtrivuk"], ["Ann"], ["Ana"], ["", "  ", "?!"]]
    rows = [(v, s, i) for v in (1, None) for i, g in enumerate(groups) for s in g] + [(1, None, 0), (1, "Person 27", 0), (2, "Hunnaelgra", 0)]
    df = spark.createDataFrame(rows, "video long, label string, member int")
    got = {(r.video, r.member): r.cluster_key for r in clusters.spelling_clusters(df, "video", "label").collect()}
    want = {(v, s): min(g) for v in (1, None) for g in groups for s in g} | {(2, "Hunnaelgra"): "Hunnaelgra"}
    assert got == want
    assert clusters.spelling_clusters(df.limit(0), "video", "label").count() == 0


# ---- 5 ------------------------------------------------------------------------------------------


def test_ranking_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([0.1, 0.5, 0.9, rng.random()]), rng.random() * 100, rng.choice([1.0, 2.0]), "x") for g in (1, 2, None) for i in range(40)]
    rows += [(3, i, 1.0, 1.0, 1.0, "x") for i in range(9)] + [(1, 90, None, 1.0, 1.0, "x"), (1, 91, float("nan"), 1.0, 1.0, "x"), rows[0]]
    df = spark.createDataFrame(rows, "g long, i long, a double, b double, c double, closeness string")
    got = ranking.ideal_point_ranking(df, ["g"], ["i"], ["a", "b", "c"], least_group=10).collect()
    assert len(got) == 120
    for g in (1, 2, None):
        own = [r for r in rows[:120] if r[0] == g]
        top = {r[1] for r in own if all(5 * sum(o[k] > r[k] for o in own) < len(own) for k in (2, 3, 4))}
        mine = [r for r in got if r.g == g]
        assert {r.i for r in mine if r.in_top} == top and {r.i for r in mine if r.can_top} >= top
        assert all(r.place == 1 + sum(o.closeness > r.closeness for o in mine) for r in mine)
    assert ranking.ideal_point_ranking(df.limit(0), ["g"], ["i"], ["a"]).count() == 0


def test_ranking_of_small_groups(spark, tmp_path):
    """p5_ranking ranks groups of any size, p5_found those of ten and more."""
    events = [(v, i, 1000.0 * i, 1000.0 * i + 1000, 0.1 * i) for v, n in ((1, 3), (2, 12)) for i in range(n)]
    packets = [(v, start, 0.01 * i, 0.02 * i, 0.03 * i) for v, i, start, _, _ in events]
    spark.createDataFrame(events, "video_id long, event_id long, start_time_ms double, end_time_ms double, importance double").write.parquet(f"{tmp_path}/video_event.parquet")
    spark.createDataFrame(packets, "video_id long, timestamp_ms double, motion_score double, audio_energy double, novelty_score double").write.parquet(f"{tmp_path}/frame_packet.parquet")
    got = {(r.video_id, r.event_id): r.place for r in queries.p5_ranking(spark, str(tmp_path)).collect()}
    assert set(got) == {e[:2] for e in events} and got[1, 2] == 1 and got[2, 11] == 1
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == {(2, 9), (2, 10), (2, 11)}


# ---- 6 ------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(["alpha", "été", "x1", "\n", "Straße"], k=rng.choice([1, 40, 300, 900]))) for i in range(120)} | {120: "ab " * 3000, 121: "", 122: None, 123: "<|endoftext|>"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "part long, text string, container int").repartition(5)
    rows = packing.pack_documents(df, "part", "text", capacity=512, open_windows=4).collect()
    sizes = dict(zip(texts, packing.token_counts(list(texts.values()), packing.TOKENIZER)))
    fill, got = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        got.setdefault(r.part, []).append((r.first_token, r.n_tokens))
    assert max(fill.values()) <= 512 and 121 not in got and 122 not in got
    for i, n in sizes.items():
        own = sorted(got.get(i, []))
        assert sum(k for _, k in own) == n and (len(own) == -(-n // 512)) and [a for a, _ in own] == list(range(0, n, 512))
    assert sum(fill.values()) / (512 * len(fill)) > 0.9
    assert packing.pack_documents(df.limit(0), "part", "text").count() == 0


# ---- 7 ------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    have = {d: grams(t) for d, t in docs}
    out = set()
    for i, t in items:
        g = grams(t)
        out |= {(d, i) for d, h in have.items() if g and 4 * len(g & h) >= len(g)}
    return out


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_leaks(spark, most):
    """Isolated five-word runs are found too; the broadcast and the shuffled way agree with brute force."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(25)] + [(25, None), (26, "too short"), (27, "")]
    docs = [(0, None), (1, ""), (2, "W1_w2")]
    for d in range(3, 90):
        own = rng.choices(words, k=120)
        src = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, 4)):
            a, b, k = rng.randrange(35), rng.randrange(100), rng.choice([5, 6, 9])
            own[b : b + k] = src[a : a + k]
        docs.append((d, rng.choice([" ", "  ", "_", ", "]).join(own).upper()))
    corpus = spark.createDataFrame([(d, t, 0.5) for d, t in docs] + [(5, docs[5][1], 0.1)], "id long, text string, share double")
    held = spark.createDataFrame(items, "id long, body string")
    got = leakage.leaked_items(corpus, "id", "text", held, "id", "body", leakage.Winnow(most_broadcast=most)).collect()
    want = brute_leaks(docs, items)
    assert {(r.id, r.id_) for r in got} == want and want
    assert leakage.leaked_items(corpus.limit(0), "id", "text", held, "id", "body").count() == 0


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 5, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]) for _ in "ab")
        assert set(leakage.winnow(leakage.grams(a, 4), 2)) & set(leakage.winnow(leakage.grams(b, 4), 2))


# ---- 8 ------------------------------------------------------------------------------------------


def test_personal_data(spark):
    given, family = ["Kifoa", "Tigra", "Mothma", "Bretae", "Nundro"], ["Taltromark", "Nispo", "Brure", "Kakmosen", "Fandra"]
    known = [(g, "given") for g in given[:4]] + [(f, "family") for f in family[:4]]
    docs = [(i, f"Nothing stands here. Credits: camera by {g} {f}, third row.") for i, (g, f) in enumerate(zip(given * 4, family * 4))]
    docs += [
        (50, "Write to tigra.nispo @ post.test, or kifoa (at) mail (dot) test before Friday. Reel 0060-9786 runs 562.816."),
        (51, "Call +44 1632 960145 or (253) 555-0184 today. ID no. 666-96-8672 and QQ 03 82 07 A were read."),
        (52, "Return tapes to: Flat 3, 209 Fakvaek Lane"),
        (53, "Retour des bobines : 42 bis, avenue de Naskik La lumière devient verte."),
        (54, "Rücksendung an: Tonzundweg 93a. Devolver a: Avda. Kaerorv 139, 2.º B, con permiso."),
        (55, "The Taltromark lens was soft. Kifoa nods. Golden Fowolm runs 96 minutes."),
        (56, "According to Brure, Tigra, the cue came late; Bretae J. van Kakmosen asked."),
        (57, None),
        (58, ""),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "start long, text string, kind string")
    parts = spark.createDataFrame(known, "name_text string, name_kind string")
    found = pii.find_personal(df, "start", "text", parts, "name_text", "name_kind")
    got = {(r.start, r[3], r[4]) for r in found.collect()}
    at = lambda i: {(k, t) for d, k, t in got if d == i}
    assert at(0) == {("name", "Kifoa Taltromark")} and at(4) == {("name", "Nundro Fandra")}
    assert ("phone", "+44 1632 960145") in at(51) and ("id_number", "666-96-8672") in at(51)
    assert at(52) == {("street_address", "Flat 3, 209 Fakvaek Lane")}
    assert at(53) == {("street_address", "42 bis, avenue de Naskik")}
    assert at(54) == {("street_address", "Tonzundweg 93a"), ("street_address", "Avda. Kaerorv 139, 2.º B")}
    assert at(55) == set() and at(57) == set()
    assert at(56) == {("name", "Brure, Tigra"), ("name", "Bretae J. van Kakmosen")}


def test_redact(spark):
    df = spark.createDataFrame([(1, "Mail a@b.test or call."), (2, None), (3, "plain")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 5, 13, "email")], "doc_id long, start int, stop int, kind string")
    assert {r.doc_id: r.text for r in pii.redact(df, "doc_id", "text", spans).collect()} == {1: "Mail [EMAIL] or call.", 2: None, 3: "plain"}


def written_corpus(n, seed):
    """``n`` texts with names and numbers in their contexts, and capital pairs that are none: (texts, true pairs by kind)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize()
    given, family = [word() + "a" for _ in range(60)], [word() + "sen" for _ in range(60)]
    frames = ["Credits: camera by {}, third row.", "According to {}, the cue was late.", "The last to leave at night was {}.", "{} asked us to wait."]
    other = ["He sets down a Schachtel Filmrollen im Hof.", "Neither Falmo nor Zarko opens the gate.", "Golden {f} runs 96 minutes.", "The {f} lens was soft.", "Cut to a Schachtel Filmrollen near the door.", "The Schachtel Filmrollen stands on the beach.", "We saw a Schachtel Filmrollen asked us to wait."]
    rows, truth = [], set()
    for i in range(n):
        parts = [rng.choice(other).format(f=rng.choice(family)) for _ in range(3)]
        if rng.random() < 0.5:
            name = f"{rng.choice(given)} {rng.choice(family)}"
            parts.insert(rng.randrange(4), rng.choice(frames).format(name))
            truth.add((i, "name", name))
        if rng.random() < 0.3:
            phone = f"+44 {rng.randrange(1000, 9999)} {rng.randrange(100000, 999999)}"
            parts.append(f"Call {phone} today.")
            truth.add((i, "phone", phone))
        rows.append((i, " ".join(parts)))
    known = [(g, "given") for g in given[:40]] + [(f, "family") for f in family[:40]]
    return rows, truth, known


@pytest.mark.parametrize("n", [400, 4000])
def test_personal_data_at_every_size(spark, n):
    """The same texts ten times as many: precision and recall stay."""
    rows, truth, known = written_corpus(n, 3)
    df = spark.createDataFrame(rows, "id long, body string")
    names = spark.createDataFrame(known, "part string, role string")
    got = {(r.id, r.kind, r.text) for r in pii.find_personal(df, "id", "body", names, "part", "role").collect()}
    for kind in ("name", "phone"):
        own, want = {g for g in got if g[1] == kind}, {t for t in truth if t[1] == kind}
        assert len(own & want) >= 0.98 * len(want) and len(own & want) >= 0.98 * len(own), (kind, len(own), len(want), sorted(own - want)[:5])


def test_personal_data_far_apart_and_repeated_keys(spark):
    """Pieces far longer than usual, overlaps, and one key with two texts."""
    long = "x" * 3000
    texts = [(1, f"Write to {long}@{long}.test now."), (1, "Call +44 1632 960145 today."), (2, f"Return to 12 {'Bo' + 'b' * 200} Lane today."), (None, "Call +44 1632 960145")]
    df = spark.createDataFrame(texts, "id long, body string")
    names = spark.createDataFrame([], "part string, role string")
    found = pii.find_personal(df, "id", "body", names, "part", "role", with_hash=True)
    got = {(r.id, r.kind, r.text) for r in found.collect()}
    assert got == {(1, "email", f"{long}@{long}.test"), (1, "phone", "+44 1632 960145"), (2, "street_address", f"12 {'Bo' + 'b' * 200} Lane")}
    clean = {r.body for r in pii.redact(df, "id", "body", found, text_hash="hash").collect()}
    assert clean == {"Write to [EMAIL] now.", "Call [PHONE] today.", "Return to [STREET_ADDRESS] today.", "Call +44 1632 960145"}
    spans = [("a", 1, 0, 5, "name", "p", 3.0), ("a", 1, 4, 9, "name", "q", 2.0), ("a", 1, 8, 12, "name", "r", 1.0), ("b", 1, 0, 5, "name", "p", 3.0)]
    rows = spark.createDataFrame(spans, "doc string, hash long, start int, stop int, kind string, text string, sure double")
    assert {(r.doc, r.text) for r in pii.apart(rows).collect()} == {("a", "p"), ("a", "r"), ("b", "p")}
