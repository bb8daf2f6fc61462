"""Queries over the training-data operators, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinemill.llm.clusters import spelling_clusters, vector_clusters
from cinemill.llm.leakage import leaked_items
from cinemill.llm.neighbours import Index, exact_cosines, nearest
from cinemill.llm.packing import container_fill, pack_documents
from cinemill.llm.pii import find_personal, redact
from cinemill.llm.ranking import ideal_point_ranking
from cinemill.llm.repetition import compression_bands
from cinemill.plans.tables import table
from cinemill.session import cut

HOUR_MS = 3_600_000
#: Most nearest vectors lie at cosines of 0.3 to 0.6, where six cells of 100 hold too few of them; p2_found's pairs don't.
#: Few large cells shuffle less than many small ones at the same recall.
KNN = Index(cell=3000, probes=4, tile=65_536)
#: Few vectors reach the least cosine of p2_found's pairs, so a wide error bound costs nothing there.
PAIRS = Index(error=4.0)


def p1_bands(spark, folder):
    """The exact share and verdict of every summary."""
    measured = compression_bands(table(spark, folder, "video_event"), ["video_id", "event_id"], "summary").distinct()
    return measured.select("video_id", "event_id", "n_words", "repeated_words", F.round("repeated_share", 9).alias("repeated_share"), "repetitive")


def p1_ratios(spark, folder):
    """The ratios behind it, with the limits and verdicts of every length band."""
    return compression_bands(table(spark, folder, "video_event"), ["video_id", "event_id"], "summary").distinct().drop("repeated_share")


def p1_found(spark, folder):
    measured = compression_bands(table(spark, folder, "video_event"), ["video_id", "event_id"], "summary")
    return measured.filter("repetitive").select("video_id", "event_id").distinct()


def _vectors(spark, folder):
    """(item_kind, table with video and key, name of the vector column)."""
    seconds = table(spark, folder, "temporal_feature").select(
        F.col("video_id").alias("video"), F.floor(F.col("timestamp_ms") / 1000).alias("key"), F.col("multimodal_embedding").alias("vector")
    )
    events = table(spark, folder, "video_event").select(F.col("video_id").alias("video"), F.col("event_id").alias("key"), F.col("event_embedding").alias("vector"))
    return {"second": seconds, "event": events}


def p2_knn(spark, folder):
    """The five most similar vectors of every vector, by reranked cosine."""
    parts = [
        nearest(df, ["video", "key"], "vector", index=KNN).select(
            F.lit(kind).alias("item_kind"),
            F.col("q.video").alias("video_id"),
            F.col("q.key").alias("item_key"),
            F.col("n.video").alias("near_video_id"),
            F.col("n.key").alias("near_key"),
            "cosine",
        )
        for kind, df in _vectors(spark, folder).items()
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark, folder, least: float = 0.9, k: int = 5):
    """Pairs from the index with some room (in cosine and in k) for the rerank's error, then held to exact cosines."""
    parts = []
    for kind, df in _vectors(spark, folder).items():
        near = cut(nearest(df, ["video", "key"], "vector", k=2 * k, least=least - 0.015, index=PAIRS))
        exact = exact_cosines(near, df, ["video", "key"], "vector").filter(F.col("cosine") >= least)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "n"))
        pairs = exact.withColumn("place", place).filter(F.col("place") <= k)
        a, b = F.least("q", "n"), F.greatest("q", "n")
        parts.append(pairs.select(F.lit(kind).alias("item_kind"), a["video"].alias("video_a"), a["key"].alias("key_a"), b["video"].alias("video_b"), b["key"].alias("key_b")))
    return parts[0].unionByName(parts[1]).distinct()


def _faces_and_labels(spark, folder):
    seconds = table(spark, folder, "temporal_feature").filter(F.size("face_embeddings") > 0)
    faces = seconds.select("video_id", F.floor(F.col("timestamp_ms") / 1000).alias("second"), F.posexplode("face_embeddings").alias("place", "face"))
    faces = faces.select("video_id", F.format_string("%08d-%d", "second", "place").alias("member"), "face")
    return faces, table(spark, folder, "video_event").select("video_id", F.explode("character_labels").alias("label"))


def p3_clusters(spark, folder):
    """Every face and every spelling with its cluster's key and size; the most typical members have a place."""
    faces, labels = _faces_and_labels(spark, folder)
    columns = ["video_id", "member", "cluster_key", "cluster_size", "typical", "typical_place"]
    return vector_clusters(faces, "video_id", "member", "face").select(F.lit("face").alias("item_kind"), *columns).unionByName(
        spelling_clusters(labels, "video_id", "label").select(F.lit("label").alias("item_kind"), *columns)
    )


def p3_found(spark, folder):
    faces, labels = _faces_and_labels(spark, folder)
    both = ((vector_clusters(faces, "video_id", "member", "face", describe=False), "face"), (spelling_clusters(labels, "video_id", "label"), "label"))
    found = [df.select(F.lit(kind).alias("item_kind"), "video_id", F.col("member").alias("member_key"), "cluster_key") for df, kind in both]
    return found[0].unionByName(found[1])


def event_scores(spark, folder, slot_ms: int = 60_000):
    """The events with the largest usable motion, audio and novelty score of their packets.

    Packets and events meet on minutes of a stream, so a hot stream spreads over as many tasks as it has
    minutes; an event stands in every minute that it touches.
    """
    t = F.col("timestamp_ms")
    usable = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0), F.col(c))
    packets = table(spark, folder, "frame_packet").filter(t.isNotNull() & ~F.isnan(t)).select(
        "video_id",
        F.floor(t / slot_ms).alias("slot"),
        t.alias("t"),
        F.when(F.col("motion_score").between(0.0, 1.0), F.col("motion_score")).alias("motion_score"),
        usable("audio_energy").alias("audio_energy"),
        usable("novelty_score").alias("novelty_score"),
    )
    packets = packets.filter("motion_score is not null or audio_energy is not null or novelty_score is not null")
    start, end = F.col("start_time_ms"), F.col("end_time_ms")
    events = table(spark, folder, "video_event").filter((end > start) & ~F.isnan(end) & F.col("importance").isNotNull() & ~F.isnan("importance"))
    events = events.select("video_id", "event_id", "start_time_ms", "end_time_ms", "importance").dropDuplicates(["video_id", "event_id"])
    slots = events.withColumn("slot", F.explode(F.sequence(F.floor(start / slot_ms), F.floor(end / slot_ms))))
    met = packets.join(slots, ["video_id", "slot"]).filter((F.col("t") >= start) & (F.col("t") < end))
    best = [F.max(c).alias(c) for c in ("motion_score", "audio_energy", "novelty_score")]
    return met.groupBy("video_id", "event_id").agg(
        F.floor(F.first("start_time_ms") / HOUR_MS).alias("hour"), *best, F.first("importance").alias("importance")
    )


def _ranked(spark, folder, least_group: int):
    scores = ["motion_score", "audio_energy", "novelty_score", "importance"]
    return ideal_point_ranking(event_scores(spark, folder), ["video_id", "hour"], ["event_id"], scores, least_group=least_group)


def p5_ranking(spark, folder):
    """Every event with all four scores, in groups of any size."""
    return _ranked(spark, folder, 1).select("video_id", "event_id", "closeness", "place", "group_size")


def p5_found(spark, folder):
    return _ranked(spark, folder, 10).filter("in_top").select("video_id", "event_id")


def _packed(spark, folder):
    return pack_documents(table(spark, folder, "documents"), "doc_id", "text")


def p6_containers(spark, folder):
    return container_fill(_packed(spark, folder))


def p6_found(spark, folder):
    return _packed(spark, folder).filter("n_parts > 1").select("doc_id").distinct()


def p7_spans(spark, folder):
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_item"), "item_id", "text")


def p7_found(spark, folder):
    return p7_spans(spark, folder).select("doc_id", "item_id")


def _personal(spark, folder, **how):
    return find_personal(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "person_name"), "name_text", "name_kind", **how)


def p8_found(spark, folder):
    return _personal(spark, folder).select("doc_id", F.col("kind").alias("pii_kind"), F.col("text").alias("pii_text")).distinct()


def p8_redacted(spark, folder):
    """The texts with a typed placeholder in place of every piece of personal data."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return redact(documents, "doc_id", "text", _personal(spark, folder, with_hash=True), text_hash="hash")


QUERIES = {
    "p1_found": p1_found,
    "p1_bands": p1_bands,
    "p1_ratios": p1_ratios,
    "p2_found": p2_found,
    "p2_knn": p2_knn,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p5_found": p5_found,
    "p5_ranking": p5_ranking,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

_LEAK = r"""d as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws from eval_item),
ig as (select distinct item_id, p q, array_to_string(ws[p:p+4], ' ') g from (select *, unnest(range(1, len(ws) - 3)) p from i)),
dg as (select doc_id, p, array_to_string(ws[p:p+4], ' ') g from (select *, unnest(range(1, len(ws) - 3)) p from d)),
m as (select doc_id, item_id, g, p, q from dg join ig using (g)),
n as (select item_id, count(distinct g) n from ig group by 1),
s as (select doc_id, item_id, n, count(distinct g) c from m join n using (item_id) group by 1, 2, 3 having 4 * count(distinct g) >= n)"""

SQL = {
    "p1_found": """with e as (select distinct video_id, event_id, regexp_extract_all(lower(summary), '[a-z]+') ws from video_event),
g as (select video_id, event_id, len(ws) n, p, array_to_string(ws[p:p+3], ' ') g
      from (select *, unnest(range(1, len(ws) - 2)) p from e where len(ws) >= 12)),
r as (select *, min(p) over (partition by video_id, event_id, g) f from g),
w as (select distinct video_id, event_id, n, p + unnest([0, 1, 2, 3]) q from r where p > f)
select video_id, event_id from w group by 1, 2, n having 20 * count(*) >= 7 * n""",
    "p5_found": """with v as (select distinct video_id, event_id, start_time_ms s, end_time_ms e, importance i from video_event where importance is not null and not isnan(importance)),
x as (select v.video_id, event_id, floor(s / 3600000) h, i,
    max(motion_score) filter (motion_score between 0 and 1 and not isnan(motion_score)) m,
    max(audio_energy) filter (audio_energy >= 0 and not isnan(audio_energy)) a,
    max(novelty_score) filter (novelty_score >= 0 and not isnan(novelty_score)) n
  from v join frame_packet p on p.video_id = v.video_id and timestamp_ms >= s and timestamp_ms < e group by v.video_id, event_id, s, i),
y as (select * from x where m is not null and a is not null and n is not null),
z as (select *, count(*) over g c, rank() over (partition by video_id, h order by m desc) - 1 rm, rank() over (partition by video_id, h order by a desc) - 1 ra,
    rank() over (partition by video_id, h order by n desc) - 1 rn, rank() over (partition by video_id, h order by i desc) - 1 ri
  from y window g as (partition by video_id, h))
select video_id, event_id from z where c >= 10 and 5 * rm < c and 5 * ra < c and 5 * rn < c and 5 * ri < c""",
    "p7_found": f"""with {_LEAK}
select doc_id, item_id from s""",
    "p7_spans": f"""with {_LEAK},
o as (select doc_id, item_id, p, p - q line, p - row_number() over (partition by doc_id, item_id, p - q order by p) run from m join s using (doc_id, item_id)),
r as (select doc_id, item_id, min(p) a, max(p) b from o group by doc_id, item_id, line, run),
k as (select *, count(*) over (partition by doc_id, item_id) spans, row_number() over (partition by doc_id, item_id order by b - a desc, a) place from r)
select doc_id, item_id, c as shared, n as sequences, c / n as share, spans, a - 1 as first_word, b + 3 as last_word from k join s using (doc_id, item_id) where place = 1""",
    "p1_bands": r"""with e as (select distinct video_id, event_id, regexp_extract_all(lower(summary), '[a-z]+') ws from video_event),
g as (select video_id, event_id, p, array_to_string(ws[p:p+3], ' ') g from (select *, unnest(range(1, len(ws) - 2)) p from e)),
r as (select *, min(p) over (partition by video_id, event_id, g) f from g),
w as (select video_id, event_id, count(distinct q) c from (select video_id, event_id, p + unnest([0, 1, 2, 3]) q from r where p > f) group by 1, 2)
select video_id, event_id, coalesce(len(ws), 0) as n_words, coalesce(c, 0) as repeated_words,
  round(case when len(ws) > 0 then coalesce(c, 0) / len(ws) else 0 end, 9) as repeated_share,
  coalesce(len(ws) >= 12 and 20 * coalesce(c, 0) >= 7 * len(ws), false) as repetitive
from e left join w using (video_id, event_id)""",
    "p5_ranking": """with v as (select distinct video_id, event_id, start_time_ms s, end_time_ms e, importance i from video_event where importance is not null and not isnan(importance)),
x as (select v.video_id, event_id, floor(s / 3600000) h, i,
    max(motion_score) filter (motion_score between 0 and 1 and not isnan(motion_score)) m,
    max(audio_energy) filter (audio_energy >= 0 and not isnan(audio_energy)) a,
    max(novelty_score) filter (novelty_score >= 0 and not isnan(novelty_score)) n
  from v join frame_packet p on p.video_id = v.video_id and timestamp_ms >= s and timestamp_ms < e group by v.video_id, event_id, s, i),
y as (select * from x where m is not null and a is not null and n is not null),
l as (select video_id, event_id, h, unnest([m, a, n, i]) val, unnest([0, 1, 2, 3]) k from y),
t as (select *, cume_dist() over (partition by video_id, h, k order by val) c from l),
q as (select video_id, h, k, min(val) filter (c >= 0.05 - 1e-12) lo, min(val) filter (c >= 0.95 - 1e-12) hi from t group by all),
b as (select video_id, h, k, lo, hi, sqrt(sum(least(greatest(val, lo), hi) ^ 2)) nm from l join q using (video_id, h, k) group by all),
z as (select video_id, event_id, h, sqrt(sum(case when nm > 0 then ((hi - least(greatest(val, lo), hi)) * 0.25 / nm) ^ 2 else 0 end)) far,
    sqrt(sum(case when nm > 0 then ((least(greatest(val, lo), hi) - lo) * 0.25 / nm) ^ 2 else 0 end)) near
  from l join b using (video_id, h, k) group by all),
f as (select video_id, event_id, h, round(case when far + near > 0 then near / (far + near) else 0.5 end, 9) closeness from z)
select video_id, event_id, closeness, rank() over (partition by video_id, h order by closeness desc) as place, count(*) over (partition by video_id, h) as group_size from f""",
}
