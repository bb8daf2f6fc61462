"""Audio features, and chains of adapters with stubs in place of models."""

import io
import sys
import wave

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from cinemill.operators import audio, captions
from cinemill.sources import manifest, media

register_pickle_by_value(sys.modules[__name__])  # the stubs go to workers that don't know this module
P = audio.Spectrum(rate=8000, frame=256, hop=64, bands=20, cepstrum=5)


def brute(x, p, window):
    """The same features, window by window, from their definitions."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.frame) / p.frame)

    def spectra(y, hop):
        y = np.pad(y, p.frame // 2)
        return np.array([np.abs(np.fft.rfft(y[i : i + p.frame] * hann)) for i in range(0, len(y) - p.frame + 1, hop)])

    mel = audio.mel_filters(p)
    whole = 10 * np.log10(np.maximum((spectra(x, window) ** 2) @ mel.T, 1e-10))
    whole = np.maximum(whole, whole.max() - p.floor_db)
    flux = np.r_[0.0, np.maximum(np.diff(whole, axis=0), 0).mean(axis=1)]
    out = []
    for i in range(len(x) // window):
        w = x[i * window : (i + 1) * window]
        s = spectra(w, p.hop)
        edge = np.pad(w, p.frame // 2, mode="edge")
        crossings = [np.mean(np.r_[False, np.signbit(f[1:]) != np.signbit(f[:-1])]) for f in (edge[k : k + p.frame] for k in range(0, len(edge) - p.frame + 1, p.hop))]
        at = np.linspace(0, p.rate / 2, p.frame // 2 + 1)
        out.append((np.sqrt(np.mean(w * w)), min(flux[i] / (flux.max() + 1e-9), 1), np.mean(crossings), np.mean([(f @ at) / f.sum() for f in s])))
    return out


def test_audio_features(spark):
    rng = np.random.default_rng(0)
    t = np.arange(9100) / P.rate
    x = np.where(t < 0.5, np.sin(2 * np.pi * 440 * t), 0.3 * rng.standard_normal(len(t))) * (0.2 + (t > 0.8))
    df = spark.createDataFrame([("a", i, float(v), 1) for i, v in enumerate(x)] + [("b", i, 0.0, 1) for i in range(2100)] + [("c", 0, None, 1), ("c", None, 1.0, 1)], "stream string, at long, x double, energy int")
    rows = audio.audio_features(df, "stream", "at", "x", window_ms=250.0, spectrum=P).orderBy("stream", "idx").collect()
    a, b = ([r for r in rows if r.stream == s] for s in "ab")
    want = brute(x, P, 2000)
    assert len(a) == 4 == len(want) and len(b) == 1 and not [r for r in rows if r.stream == "c"]
    loudest = 5 * np.sqrt(np.mean(x * x)) + 1e-9
    for r, (rms, flux, crossing, centroid) in zip(a, want):
        assert np.allclose([r.energy, r.spectral_flux, r.zero_crossing, r.centroid], [min(rms / loudest, 1), flux, crossing, centroid], rtol=1e-5)
        assert len(r.cepstrum) == 5 and r.speech in (0.1, 0.4, 0.75) and r.music in (0.2, 0.5, 0.8)
    assert b[0].silence and b[0].energy == 0 and b[0].centroid == 0 and not a[0].silence and 400 < a[0].centroid < 520
    with pytest.raises(ValueError):
        audio.audio_features(df, "stream", "at", "x", window_ms=1.0, spectrum=P)


class Says:
    def __init__(self, answer, ready=True):
        self.answer, self.able = answer, ready

    def ready(self):
        return self.able

    def ask(self, image, prompt, system, most_tokens):
        if self.answer is None:
            raise RuntimeError
        return self.answer if most_tokens < 130 else f"{self.answer} {system}"


class Sees:
    def __init__(self, boxes, ready=True):
        self.boxes, self.able = boxes, ready

    def ready(self):
        return self.able

    def detect(self, image):
        if self.boxes is None:
            raise RuntimeError
        return self.boxes

    def embed(self, part):
        return [3.0, 4.0 * part.shape[1]] if part.mean() > 1 else None


def images(spark, column):
    bright, black = np.full((4, 6, 3), 90, np.uint8), np.full((4, 6, 3), 4, np.uint8)
    rows = [(0, (4, 6, bytearray(bright.tobytes()))), (1, (4, 6, bytearray(black.tobytes()))), (2, None), (3, (4, 6, bytearray(b"xx")))]
    return spark.createDataFrame(rows, f"n long, {column} struct<h:int,w:int,rgb:binary>")


def test_captions(spark):
    events = images(spark, "key_image").withColumns({"event_type": F.lit("Action"), "location_label": F.lit("street"), "max_characters_seen": F.lit(2), "dialogue_text": F.lit(None).cast("string"), "character_labels": F.array(F.lit("Person A")), "summary": F.lit("old")})
    template = "Action event in street, 2 people present"
    said = lambda router, **k: [r.summary for r in captions.summarised(events, router, **k).orderBy("n").collect()]
    router = captions.Router({"one": Says("A man runs down a wet street."), "two": Says("Let me know if you need more."), "bad": Says(None), "off": Says("x", False)}, "one")
    calls = spark.sparkContext.accumulator(0)
    assert said(router, calls=calls) == ["A man runs down a wet street.", template, template, template] and calls.value == 4
    assert all(said(router.using(b)) == [template] * 4 for b in ("two", "bad", "off", "none"))
    talk = captions.summarised(events.withColumn("dialogue_text", F.lit("Stop!")), router).orderBy("n").first().summary
    assert '"Stop!"' in talk and "Person A" in talk
    assert (router.mode(), router.using("off").mode(), captions.Router().mode()) == ("one", "unavailable", "none")
    with pytest.raises(ValueError):
        router.using("three")


def test_scene_labels(spark):
    frames = images(spark, "image").withColumn("v", F.when(F.col("n") == 0, F.array(F.lit(0.1), F.lit(2.0))))
    got = lambda **k: [r.scene_label for r in captions.scene_labels(frames, ["kitchen", "beach"], **k).orderBy("n").collect()]
    table = {"kitchen": [1.0, 0.0], "beach": [0.0, 1.0]}
    assert got(vector="v", table=table) == ["beach", "unknown", "unknown", "unknown"]
    assert got(router=captions.Router({"m": Says("It is a Kitchen.")}, "m"), vector="v", table=table)[0] == "kitchen"
    assert got(router=captions.Router({"m": Says("no idea")}, "m"))[0] == "unknown" and got()[0] == "office"


def test_faces(spark):
    frames = images(spark, "image")
    boxes = [(-2, -1, 5, 4), (5, 3, 9, 9), (6, 0, 2, 2), (0, 0, 0, 3)]
    rows = captions.detected_faces(frames, [Sees([(0, 0, 1, 1)], False), Sees(boxes)])
    assert [r.faces for r in rows.orderBy("n").collect()] == [4, 0, 0, 0]
    vectors = captions.face_vectors(rows, Sees([])).orderBy("n").first().face_embeddings
    assert len(vectors) == 2 and np.allclose(vectors, [np.array([3, 12.0]) / np.hypot(3, 12), [0.6, 0.8]])
    assert captions.face_vectors(rows, None).first().face_embeddings == []
    assert all([r.faces for r in captions.detected_faces(frames, d).collect()] == [0] * 4 for d in ([], [Sees(None)]))


class Sound:
    def probe(self, path):
        return {"fps": 25.0}

    def samples(self, path):
        return (8000, [] if "mute" in path else [0.0, 0.5, -0.5, 2.0])


class Hears:
    def __init__(self, cues):
        self.given = cues

    def cues(self, path):
        if self.given is None:
            raise RuntimeError
        return self.given


def test_sound_files_and_transcription(spark):
    rows = media.wav_files(spark, ["/x/a.mp4", "/x/mute.mp4"], Sound()).collect()
    assert [r.video_id for r in rows] == ["a"]
    with wave.open(io.BytesIO(bytes(rows[0].wav))) as f:
        assert (f.getnchannels(), f.getframerate(), f.getsampwidth(), f.getnframes()) == (1, 16_000, 2, 8)
    chain = [Hears(None), Hears([(0.0, 1.0, " ")]), Hears([(0.0, 900.0, "Hello."), (1.0, 2.0, "")]), Hears([(5.0, 6.0, "late")])]
    assert [tuple(r) for r in media.transcribe(spark, ["/x/a.mp4"], chain).collect()] == [("a", 0, 0.0, 900.0, "Hello.")]
    assert media.transcribe(spark, ["/x/a.mp4"], []).count() == 0 == media.transcribe(spark, ["/x/a.mp4"], None).count()


def test_frames_of_streams_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, 1, 1, bytearray(b"123")), ("c", 1, 1, 1, bytearray(b"456"))], "video_id string, frame_id long, h int, w int, rgb binary")
    media.write_frames(df, str(tmp_path), lambda h, w, rgb: bytes(rgb))
    assert {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*.jpg")} == {"a%2Fb/frame_00000001.jpg": b"123", "c/frame_00000001.jpg": b"456"}


def test_events_file_and_graph(spark, tmp_path):
    import json

    rows = [(1, 0, 0.04, 5000.0, None, [0.1234567, 1.0]), (1, 1, 5000.0, 6000.0, 'a "b"', None), (2, 0, 0.0, 1.0, "x", None)]
    e = spark.createDataFrame(rows, "video_id long, event_id long, start_time_ms double, end_time_ms double, summary string, event_embedding array<float>")
    e = e.withColumns({c: F.lit(0.5) for c in ("importance", "confidence")} | {"duration_ms": F.col("end_time_ms") - F.col("start_time_ms"), "event_type": F.lit("Scene")})
    e = e.withColumns({c: F.lit(None).cast(t) for c, t in {"boundary_reason": "string", "character_count_range": "array<int>", "max_characters_seen": "int", "character_data_available": "boolean", "location_label": "string", "character_labels": "array<string>"}.items()})
    manifest.write_events(e, str(tmp_path / "e"), embedding=True)
    lines = [json.loads(x) for f in (tmp_path / "e").rglob("*.json") for x in f.read_text().splitlines()]
    first = next(x for x in lines if x["event_id"] == 0 and "event_embedding" in x)
    assert first["event_embedding"] == [0.123457, 1.0] and first["event_embedding_dim"] == 2 and sum("event_embedding_dim" in x for x in lines) == 1
    got = {r.video_id: json.loads(r.graph) for r in manifest.event_graph(e).collect()}
    assert got[1]["edges_before"] == [[0, 1]] and [x["before"] for x in got[1]["events"]] == [[1], []] and got[1]["events"][0]["summary"] is None
    assert got[2] == {"events": [{"event_id": 0, "start_time_ms": 0.0, "end_time_ms": 1.0, "event_type": "Scene", "summary": "x", "before": [], "causes": []}], "edges_before": []}


def test_graph_of_a_hot_stream(spark, tmp_path, monkeypatch):
    import hashlib

    from cinemill.plans import queries

    ids = [*range(0, 20_000, 2), 1_000_000]  # the last is alone in its slice
    rows = [(7, i, float(i), i + 1.0, "Scene", f"s {i}") for i in ids] + [(8, 3, 0.0, 1.0, None, None)]
    e = spark.createDataFrame(rows, "video_id long, event_id long, start_time_ms double, end_time_ms double, event_type string, summary string")
    e.write.parquet(str(tmp_path / "video_event.parquet"))
    made, graph = [], manifest.event_graph
    monkeypatch.setattr(manifest, "event_graph", lambda *a, **k: made.append(graph(*a, **k)) or made[-1])
    got = {(r.video_id, r.event_id): tuple(r)[2:] for r in queries.c12_event_graph(spark, str(tmp_path)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    chain = md5(",".join(f"{a}-{b}" for a, b in zip(ids, ids[1:])))
    assert got == {(7, i): (float(i), i + 1.0, "Scene", f"s {i}", str(n), 0, len(ids) - 1, chain) for i, n in zip(ids, [*ids[1:], ""])} | {(8, 3): (0.0, 1.0, None, None, "", 0, 0, md5(""))}
    # No value holds a whole stream: 2048 of these events at most, each under 150 letters with its edge.
    assert made[0].selectExpr("max(length(graph)) as n").first().n < 2048 * 150
    whole = [x for x in graph(e).filter("video_id = 7").collect()]
    assert len(whole) == 1 and whole[0].graph.count("event_id") == len(ids)


def test_seek_over_slices(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 1500.0), (1, 9000.0), (2, 5.0)], "video_id long, timestamp_ms double")
    f = spark.createDataFrame([(1, 1000.0, 1, 1, bytearray(b"a")), (1, 3000.0, 1, 1, bytearray(b"b"))], "video_id long, timestamp_ms double, h int, w int, rgb binary")
    got = {(r.video_id, r.timestamp_ms): r.image and bytes(r.image.rgb) for r in media.seek_images(p, f, slice_ms=2000.0).collect()}
    assert got == {(1, 0.0): None, (1, 1500.0): b"a", (1, 9000.0): b"b", (2, 5.0): None}
