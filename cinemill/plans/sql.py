"""DuckDB SQL for the queries in ``queries``, written on its own from the same definitions."""

from __future__ import annotations

from cinemill.config import RAW_WEIGHTS


def _u(x: str) -> str:
    return f"case when {x} is null or isnan({x}) then 0.0 else least(greatest({x}, 0.0), 1.0) end"


PK = f"""pk as (select video_id, frame_id, timestamp_ms t, fps_used, {_u('motion_score')} m, scene_change sc, {_u('audio_energy')} a,
  {_u('novelty_score')} n, decision_reason, subtitle_text st, image is not null img, arrived_at
  from (select *, row_number() over (partition by video_id, frame_id order by arrived_at) rn from frame_packet
        where timestamp_ms is not null and not isnan(timestamp_ms)) where rn = 1)"""
CUE = r"""cue as (select video_id, cue_idx, start_ms, end_ms, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]*>|\{[^}]*\}|♪', '', 'g'), '\s+', ' ', 'g')), '') x
  from (select distinct * from subtitle_cue where start_ms is not null and end_ms is not null and end_ms > start_ms))"""
TF = f"""tf as (select video_id, s, {_u('motion_score')} m, {_u('novelty_score')} n, {_u('audio_energy')} a, {_u('spectral_flux')} f, timestamp_ms t,
  scene_label, character_count, action_label, dialogue_present, dialogue_text, camera_cue, music_mood, image_available,
  case when len(multimodal_embedding) = 160 and len(list_filter(multimodal_embedding, lambda x: x <> 0)) > 0 then multimodal_embedding::double[] end e
  from (select *, floor(timestamp_ms / 1000)::bigint s, row_number() over (partition by video_id, floor(timestamp_ms / 1000)) rn from temporal_feature) where rn = 1)"""
EV = "ev as (select * from (select *, row_number() over (partition by video_id, event_id) rn from video_event) where rn = 1)"
DEN = """den as (select p.video_id, p.frame_id, least(coalesce(sum(greatest(least(c.end_ms, p.t + 5000) - greatest(c.start_ms, p.t), 0)) filter (c.start_ms is not null), 0), 5000) / 5000 density
  from pk p left join cue c on c.video_id = p.video_id and c.start_ms < p.t + 5000 and c.end_ms > p.t group by 1, 2)"""
IMP = "least(greatest(0.3 * m + 0.25 * coalesce(sc, false)::int + 0.2 * a + 0.1 * density + 0.15 * n, 0), 1)"
FPS = "(case when importance < 0.2 then 0.5 when importance < 0.4 then 1 when importance < 0.6 then 2 when importance < 0.8 then 5 else 10 end)::double"
WIN = """aw as (select video_id, s // 4 idx, sum(a * a) q, count(*) k from tf group by 1, 2),
ag as (select video_id, sqrt(sum(q) / sum(k)) * 5 + 1e-9 g from aw group by 1),
win as (select video_id, idx, least(sqrt(q / 4) / g, 1.0) energy, sqrt(q / 4) < 0.02 silence from aw join ag using (video_id) where k = 4)"""


def _dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]))"


def _cos(x: str, y: str) -> str:
    return f"case when {x} is null or {y} is null or list_sum(list_transform({x}, lambda q: q * q)) < 1e-20 then 0.0 else least(greatest((1 - {_dot(x, y)} / sqrt({_dot(x, x)}) / sqrt({_dot(y, y)})) / 2, 0), 1) end"


SIG = f"""lg as (select *, lag(s) over w ps, lag(scene_label) over w pscene, lag(character_count) over w pc, lag(dialogue_present) over w pd, lag(music_mood) over w pm,
    lag(action_label) over w p1, lag(action_label, 2) over w p2, lag(e) over w pe from tf window w as (partition by video_id order by s)),
sig as (select *,
  (scene_label is distinct from pscene)::int::double scene, case when character_count is null or pc is null then 0e0 else least(abs(character_count - pc) / 2, 1) end chr, (dialogue_present is distinct from pd)::int::double dlg,
  coalesce(camera_cue in ('cut', 'fade'), false)::int::double cam, (music_mood is distinct from pm)::int::double mus,
  {_cos('e', 'pe')} emb,
  case when e is null or pe is null then 0.0 else (select {_cos('x', 'e')} from (select list_transform(list_zip(e, pe), lambda z: 2 * z[1] - z[2]) x)) end perr,
  coalesce(action_label = 'fast_action' and p1 = 'fast_action' and p2 <> 'fast_action', false) spike from lg)"""

_W = {k: round(v / sum(RAW_WEIGHTS.values()), 6) for k, v in RAW_WEIGHTS.items()}
_LOW, _HIGH = 0.35 - 0.05, 0.35 + 0.05


def _confidence(x: str) -> str:
    return f"case when {x} < {_LOW} then 0.4 * {x} / {_LOW} when {x} < {_HIGH} then 0.4 + 0.4 * ({x} - {_LOW}) / ({_HIGH} - {_LOW}) else least(0.8 + 0.2 * ({x} - {_HIGH}) / (1 - {_HIGH}), 1) end"


_TERMS = [("prediction_error", "perr", True), ("scene", "scene", True), ("dialogue", "dlg", False), ("emotion", "0.0", False), ("camera", "cam", False), ("character", "chr", True), ("embedding", "emb", True), ("music", "mus", False)]
_TERM = {n: (f"case when img then {_W['character' if n == 'camera' else n]} * {x} end" if needs else f"{_W['character' if n == 'camera' else n]} * {x}") for n, x, needs in _TERMS}
_DOMINANT = "case " + " ".join(f"when {t} = greatest({', '.join(_TERM.values())}) then '{n}'" for n, t in _TERM.items()) + " end"
DEC = f"""fz as (select *, coalesce(image_available, true) img from sig),
fu as (select *, case when ps is null then 0.0 else least(greatest(
    (case when img then {_W['prediction_error']} * perr + {_W['scene']} * scene + {_W['embedding']} * emb else 0 end + {_W['dialogue']} * dlg + {_W['music']} * mus + {_W['character']} * greatest(chr, cam))
    / (case when img then {_W['prediction_error'] + _W['scene'] + _W['embedding']} else 0 end + {_W['dialogue'] + _W['emotion'] + _W['music'] + _W['character']}), 0), 1) end raw,
  case when ps is null then 'none' else {_DOMINANT} end dom from fz),
hz as (select *, ps is not null and (coalesce(camera_cue = 'cut', false) or spike or raw >= {_HIGH}) hard from fu),
hy as (select *, ps is not null and not hard and raw >= {_LOW} zone from hz),
mk as (select *, lag(raw) over w raw0, lag(dom) over w dom0, (not (coalesce(lag(zone) over w, false) and s - lag(s) over w <= 2))::int nw
  from hy where hard or zone window w as (partition by video_id order by s)),
rn as (select *, sum(nw) over (partition by video_id order by s) run from mk),
rp as (select *, row_number() over (partition by video_id, run order by s) pl from rn where zone),
held as (select video_id, s, greatest(raw, raw0) peak, case when raw > raw0 then dom else dom0 end pdom from rp where pl % 2 = 0),
dc as (select hy.*, case when hard then raw else coalesce(peak, raw) end fused, hard or peak is not null bnd, ps is not null and coalesce(camera_cue = 'cut', false) iscut,
  coalesce(pdom, dom) dom1 from hy left join held using (video_id, s)),
de as (select *, case when iscut then 'scene_change' when ps is not null and spike then 'motion_spike' else dom1 end dominant,
  case when ps is null then 0.0 when iscut then 0.95 when spike then 0.85 else {_confidence('fused')} end conf from dc)"""

SEG = """nx as (select *, coalesce(lead(bnd) over w and lead(dominant) over w = 'motion_spike', false) rew, lead(dominant) over w nd, lead(conf) over w nc
  from de window w as (partition by video_id order by s)),
st as (select *, coalesce(bnd and dominant <> 'motion_spike', false) or rew opens, case when rew and not coalesce(bnd and dominant <> 'motion_spike', false) then 'motion_spike' else dominant end why, case when rew and not coalesce(bnd and dominant <> 'motion_spike', false) then nc else conf end sure from nx),
sg as (select *, sum(opens::int) over (partition by video_id order by s) seg from st),
sp as (select video_id, seg, min(s) a, max(s) b, arg_min(why, s) why, arg_min(sure, s) sure from sg group by 1, 2),
se as (select *, a * 1000e0 start_ms, coalesce(lead(a) over w, b) * 1000e0 end_ms, coalesce(lead(why) over w, 'stream_end') boundary_reason,
  case when lead(a) over w is null then 5e-1 else lead(sure) over w end confidence, row_number() over w - 1 event_id from sp window w as (partition by video_id order by seg)),
lb as (select video_id, seg, scene_label, count(*) k, min(s) o from sg where scene_label is not null group by 1, 2, 3),
lc as (select video_id, seg, scene_label from lb qualify row_number() over (partition by video_id, seg order by k desc, o) = 1),
tx as (select video_id, seg, trim(x) x, min((s, i)) o from (select video_id, seg, s, unnest(string_split(dialogue_text, ' | ')) x, unnest(range(len(string_split(dialogue_text, ' | ')))) i
    from sg where length(dialogue_text) > 0) where trim(x) <> '' group by 1, 2, 3),
ty as (select video_id, seg, string_agg(x, ' ' order by o) dialogue_text from tx group by 1, 2),
ag as (select video_id, seg, count(*) as seconds, least(greatest(0.4 * max(m) + 0.25 * max(n) + 0.2 * avg(a) + 0.15 * avg(coalesce(dialogue_present, false)::int), 0), 1) importance,
  avg(coalesce(dialogue_present, false)::int) dl, avg(coalesce(action_label = 'fast_action', false)::int) ac, avg(coalesce(camera_cue in ('cut', 'fade', 'black'), false)::int) cm,
  max(character_count) mx, bool_or(image_available) av, string_agg(distinct character_count::varchar, ',' order by character_count::varchar) cr from sg group by 1, 2),
ee as (select se.*, ag.* exclude (video_id, seg), nullif(lc.scene_label, 'unknown') place, ty.dialogue_text from se join ag using (video_id, seg) left join lc using (video_id, seg) left join ty using (video_id, seg)),
ef as (select *, case when dl >= 0.4 then 'Dialogue' when ac >= 0.4 then 'Action' when end_ms - start_ms < 8000 or cm >= 0.5 then 'Transition' else 'Scene' end event_type from ee)"""

TEMPLATE = """event_type || ' event in ' || coalesce(place, 'unknown') || ', ' || case when mx is null then 'character data unavailable' when mx = 0 then 'no people detected'
  when mx = 1 then '1 person present' else mx || ' people present' end"""

J6 = "ms as (select e.video_id, e.event_id, e.start_time_ms, e.end_time_ms, t.* exclude (video_id) from ev e join tf t on t.video_id = e.video_id and t.t >= e.start_time_ms and t.t < e.end_time_ms)"
VOC = r"""case when regexp_matches(x, '^([A-Z][a-zA-Z]{1,20})[!.]?$') and regexp_extract(x, '^([A-Z][a-zA-Z]{1,20})[!.]?$', 1) not in (select unnest(w) from nn)
    then regexp_extract(x, '^([A-Z][a-zA-Z]{1,20})[!.]?$', 1) end hi,
  case when regexp_matches(x, ',\s*([A-Z][a-zA-Z]{1,20})[?.!]?\s*$') and regexp_extract(x, ',\s*([A-Z][a-zA-Z]{1,20})[?.!]?\s*$', 1) not in (select unnest(w) from nn)
    then regexp_extract(x, ',\s*([A-Z][a-zA-Z]{1,20})[?.!]?\s*$', 1) end md"""


def _stopwords() -> str:
    from cinemill.functions.text import NOT_NAMES

    return "nn as (select [" + ", ".join(f"'{w}'" for w in NOT_NAMES) + "] w)"


NAMES = rf"""{_stopwords()},
hd as (select e.video_id, e.character_labels, regexp_extract(c.x, '([A-Za-z]+)[^A-Za-z]*$', 1) y from ev e join cue c on c.video_id = e.video_id and c.start_ms >= e.start_time_ms and c.start_ms < e.end_time_ms),
he as (select video_id, character_labels, upper(y[1]) || lower(y[2:]) || '!' x from hd where y is not null),
hv as (select video_id, character_labels[1] label, {VOC} from he where len(character_labels) = 1),
vt as (select video_id, label, hi as name, count(*) votes from hv where hi is not null group by 1, 2, 3),
rs as (select video_id, label, arg_max(name, (votes, name)) as name, max(votes) top, sum(votes) total from vt group by 1, 2),
rv as (select video_id, label, name from rs where top >= 1 and 2 * top > total)"""


def _clock(x: str) -> str:
    return f"printf('%02d:%02d:%02d', floor({x} / 3600000)::bigint, (floor({x} / 60000) % 60)::bigint, (floor({x} / 1000) % 60)::bigint)"


def _fillers() -> str:
    from cinemill.functions.text import FILLERS

    return " or ".join("regexp_matches(t, '{}')".format(p.replace("'", "''")) for p in FILLERS)


_MATCH = "coalesce(case when q <> '' then list_filter(labels, lambda l: contains(q, l) or contains(l, q))[1] end, 'unknown')"


def _scenes() -> str:
    from cinemill.functions.text import SCENES

    return "[" + ", ".join(f"'{s}'" for s in SCENES) + "]"


SQL = {
    "j2_subtitle_at": f"""with {PK}, {CUE} select p.video_id, p.frame_id, arg_min_null(c.x, c.cue_idx) as subtitle from pk p
left join cue c on c.video_id = p.video_id and c.start_ms <= p.t and p.t < c.end_ms group by 1, 2""",
    "j3_subtitle_density": f"with {PK}, {CUE}, {DEN} select video_id, frame_id, round(density::double, 9) as density from den",
    "f14_decision": f"""with {PK}, {CUE}, {DEN}, x as (select *, {IMP} importance from pk join den using (video_id, frame_id))
select video_id, frame_id, round(importance, 9) as importance, {FPS} as target_fps, case when importance < 0.2 then 'Static / dialogue'
  when 0.3 * m >= greatest(0.25 * coalesce(sc, false)::int, 0.2 * a, 0.1 * density, 0.15 * n) then 'Fast motion'
  when 0.25 * coalesce(sc, false)::int >= greatest(0.2 * a, 0.1 * density, 0.15 * n) then 'Scene transition'
  when 0.2 * a >= greatest(0.1 * density, 0.15 * n) then 'High audio energy' when 0.1 * density >= 0.15 * n then 'Active subtitles' else 'Novel content' end as reason from x""",
    "f11_audio_windows": f"with {TF}, {WIN} select video_id, idx, idx * 4000e0 as start_ms, (idx + 1) * 4000e0 as end_ms, round(energy, 9) as energy, silence from win",
    "j1_audio_at": f"""with {TF}, {WIN}, {PK}, la as (select video_id, max(idx) z from win group by 1)
select pk.video_id, frame_id, round(coalesce(energy, 0.0), 9) as energy, coalesce(silence, true) as silence from pk left join la using (video_id)
left join win on win.video_id = pk.video_id and t >= 0 and idx = least(floor(t / 4000)::bigint, z)""",
    "f12_speech_music": f"""with {TF}, x as (select video_id, s, f between 0.03 and 0.2 z, m * 8000 c from tf)
select video_id, s as second, case when z and c < 3500 then 75e-2 when z or c < 3500 then 4e-1 else 1e-1 end as speech, case when c >= 1000 and not z then 8e-1 when c >= 1000 then 5e-1 else 2e-1 end as music from x""",
    "s3_estimated_times": f"""with {PK}, x as (select *, case when frame_id % 3 <> 0 then t end q, case when fps_used > 0 then 1000.0 / fps_used else 40.0 end step from pk),
y as (select *, count(q) over (partition by video_id order by frame_id) run from x)
select video_id, frame_id, round(coalesce(first_value(q) over w, 0) + sum(case when q is null then step else 0 end) over w, 9) as timestamp_ms from y window w as (partition by video_id, run order by frame_id)""",
    "t1_strictly_rising": f"""with {PK}, x as (select *, max(t) over (partition by video_id order by arrived_at, frame_id rows between unbounded preceding and 1 preceding) b from pk)
select video_id, frame_id from x where b is null or t > b""",
    "t2_schedule": f"""with recursive {PK}, {CUE}, {DEN}, x as (select video_id, frame_id, t, {IMP} importance from pk join den using (video_id, frame_id)),
y as (select video_id, frame_id, t, {FPS} fps from x),
k as (select video_id, min(t) t from y group by 1
  union all select y.video_id, min(y.t) from k join y on y.video_id = k.video_id and y.t - k.t >= 1000 / y.fps group by y.video_id)
select y.video_id, y.frame_id, y.t as timestamp_ms, y.fps as target_fps from y join k using (video_id, t)""",
    "t4_transitions": f"""with {PK} select video_id, frame_id, case when lag(t) over w is null then false when m = 0 then true else n > 0.45 end as scene_changed
from pk window w as (partition by video_id order by t, frame_id)""",
    "f4_correlation_distance": f"""with {TF}, x as (select video_id, s, n, e, lag(e) over (partition by video_id order by s) p from tf where e is not null),
y as (select video_id, s, n, (select corr(u, v) from (select unnest(e) u, unnest(p) v)) c from x where p is not null),
z as (select *, 1 - greatest(0, coalesce(c, 0)) d from y)
select video_id, s as second, round(d, 7) as distance, round(0.5 * d + 0.5 * n, 7) as score, 0.5 * d + 0.5 * n > 0.45 as scene_change from z""",
    "w2_novelty": f"""with {TF}, x as (select video_id, s, unnest(e) v, unnest(range(160)) i from tf where e is not null),
y as (select *, avg(v) over (partition by video_id, i order by s rows between 10 preceding and 1 preceding) a from x)
select video_id, s as second, round(case when count(a) = 0 then 0.0 else 1 - greatest(0, coalesce(corr(v, a), 0)) end, 7) as novelty from y group by 1, 2""",
    "w3_context": f"""with {TF}, x as (select video_id, s, unnest(e) v, unnest(range(160)) i from tf where e is not null),
y as (select *, avg(v) over (partition by video_id, i order by s rows between 44 preceding and current row) a from x)
select video_id, s as second, md5(string_agg(round(a * 1e6)::bigint::varchar, ',' order by i)) as mean, round(sqrt(sum(a * a)), 7) as length from y group by 1, 2""",
    "w4_recent": f"with {TF} select video_id, s as second, coalesce(array_to_string(list(action_label) over (partition by video_id order by s rows between 2 preceding and current row), ','), '') as recent from tf",
    "a1_per_second": f"""with {PK}, p as (select *, floor(t / 1000)::bigint s, case when img then frame_id % 4 end faces, n = 0 black from pk),
tx as (select video_id, s, st x, min((t, frame_id)) o from p where length(st) > 0 group by 1, 2, 3),
ty as (select video_id, s, string_agg(x, ' | ' order by o) dt from tx group by 1, 2),
lb as (select video_id, s, decision_reason l, count(*) k, min((t, frame_id)) o from p where decision_reason is not null group by 1, 2, 3),
lc as (select video_id, s, l from lb qualify row_number() over (partition by video_id, s order by k desc, o) = 1),
g as (select video_id, s, avg(m) m, avg(n) n, avg(a) a, max(faces) c, bool_or(img) img, arg_max(black, (t, frame_id)) lb, arg_max(st, (t, frame_id)) filter (st is not null) lt, count(*) k from p group by 1, 2),
h as (select *, lag(lb) over w pb, coalesce(abs(a - lag(a) over w), 0) f, lead(s) over w z from g window w as (partition by video_id order by s)),
q as (select p.video_id, p.s, t, frame_id, case when coalesce(sc, false) and not black then 'cut' when black then 'black' when pb and not black then 'fade' end cue from p join h on h.video_id = p.video_id and h.s = p.s),
r as (select video_id, s, arg_min(cue, (t, frame_id)) filter (cue is not null) cue from q group by 1, 2),
u as (select h.*, dt, l, cue from h left join ty using (video_id, s) left join lc using (video_id, s) left join r using (video_id, s)),
v as (select *, unnest(range(s, coalesce(z, s + 1))) x from u)
select video_id, x as second, coalesce(l, 'unknown') as scene_label, c as character_count, case when m < 0.2 then 'static' when m < 0.5 then 'walking' else 'fast_action' end as action_label,
  dt is not null as dialogue_present, dt as dialogue_text, case when a >= 0.25 then 'energetic' when a < 0.08 and f < 0.08 then 'calm' else 'tense' end as music_mood, case when x = s then cue end as camera_cue,
  round(m, 9) as motion_score, round(n, 9) as novelty_score, round(a, 9) as audio_energy, round(f, 9) as spectral_flux, img as image_available, x <> s as carried, case when x = s then lt end as last_text, case when x = s then k else 0 end as packets from v""",
    "b1_signals": f"""with {TF}, {SIG}, x as (select *, ps is not null k from sig)
select video_id, s as second, case when k then round(perr, 6) end as prediction_error_signal, case when k then scene end as scene_signal, case when k then dlg end as dialogue_signal, case when k then 0e0 end as emotion_signal,
  case when k then cam end as camera_signal, case when k then round(chr, 6) end as character_signal, case when k then round(emb, 6) end as embedding_signal, case when k then mus end as music_signal, spike from x""",
    "b8_decisions": f"with {TF}, {SIG}, {DEC} select video_id, s as second, round(fused, 6) as fused, dominant, round(conf, 6) as confidence, bnd as is_boundary from de",
    "t7_events": f"""with {TF}, {SIG}, {DEC}, {SEG} select video_id, event_id, start_ms, end_ms, boundary_reason, seconds, cr as counts, mx as max_characters_seen, av as character_data_available,
  place as location_label, dialogue_text, event_type, {TEMPLATE} as summary, round(importance, 9) as importance, round(confidence, 6) as confidence from ef""",
    "a10_event_embedding": f"""with {TF}, {SIG}, {DEC}, {SEG}, x as (select video_id, seg, unnest(e) v, unnest(range(160)) i from sg where e is not null),
y as (select video_id, seg, i, avg(v) q from x group by 1, 2, 3)
select y.video_id, event_id, md5(string_agg(round(q::float::double * 1e5)::bigint::varchar, ',' order by i)) as mean, round(sqrt(sum(q * q)), 5) as length from y join se using (video_id, seg) group by 1, 2""",
    "t8_force_split": f"""with recursive {TF}, {SIG}, {DEC}, rw as (select *, row_number() over (partition by video_id order by s) k from de),
f as (select video_id, 0::bigint k, null::bigint st, []::struct(s bigint, f double)[] op, null::bigint a, null::bigint b, null::bigint ea, null::bigint ez, null::varchar why, null::double sure from (select distinct video_id from tf)
  union all select video_id, k, case when over then rest[1].s when bnd then endd else st end,
    case when over then rest when bnd then (case when back is null then [] else [back] end) || [r] else op || [r] end,
    case when over then o2[1].s when bnd and len(o1) > 0 then o1[1].s end, case when over then hit[-1].s when bnd and len(o1) > 0 then o1[-1].s end,
    case when over or (bnd and len(o1) > 0) then st end, case when over then att when bnd and len(o1) > 0 then endd end,
    case when over then 'force_split_max_duration' when bnd and len(o1) > 0 then dominant end, case when over then 0.6e0 when bnd and len(o1) > 0 then conf end
  from (select *, list_filter(o2, lambda x: x.s <= att) hit, list_filter(o2, lambda x: x.s > att) rest, coalesce(back.s, s) endd,
      case when back is null then op else op[:-2] end o1
    from (select *, case when top = st and len(o2) > 1 then o2[len(o2) // 2 + 1].s else top end att
      from (select *, list_filter(o2, lambda x: x.f = mx)[1].s top
        from (select *, s - st > 60 as over, op || [r] o2, list_max(list_transform(op || [r], lambda x: x.f)) mx, case when dominant = 'motion_spike' and len(op) > 0 then op[-1] end back
          from (select f.video_id, rw.k, coalesce(f.st, rw.s) st, f.op, rw.s, rw.bnd, rw.dominant, rw.conf, {{'s': rw.s, 'f': rw.fused}} r from f join rw on rw.video_id = f.video_id and rw.k = f.k + 1)))))),
z as (select video_id, a, b, ea, ez, why, sure from f where a is not null
  union all select video_id, op[1].s, op[-1].s, st, op[-1].s, 'stream_end', 0.5e0 from f where len(op) > 0 qualify row_number() over (partition by video_id order by k desc) = 1)
select z.video_id, ea * 1000e0 as start_ms, ez * 1000e0 as end_ms, why as boundary_reason, round(sure, 9) as confidence, count(*) as seconds,
  round(least(greatest(0.4 * max(m) + 0.25 * max(n) + 0.2 * avg(tf.a) + 0.15 * avg(coalesce(dialogue_present, false)::int), 0), 1), 9) as importance
from z join tf on tf.video_id = z.video_id and tf.s between z.a and z.b group by z.video_id, ea, ez, why, sure""",
    "t6_merge": f"""with recursive {EV}, x as (select *, row_number() over (partition by video_id order by start_time_ms) k, list_sort(list_distinct(coalesce(character_count_range, []))) cr from ev where importance is not null and not isnan(importance)),
r as (select video_id, k, start_time_ms s, end_time_ms e, boundary_reason why, confidence conf, importance imp, event_type typ, cr, max_characters_seen mx, location_label place, event_embedding emb, 1 mf, true fresh, dialogue_text dt from x where k = 1
  union all select video_id, k, case when j then s else s2 end, e2, why2, case when j then least(conf, conf2) else conf2 end,
    case when not j then imp2 when e - s + e2 - s2 > 0 then (imp * (e - s) + imp2 * (e2 - s2)) / (e - s + e2 - s2) else (imp + imp2) / 2 end,
    case when j then typ else typ2 end, case when j then list_sort(list_distinct(list_concat(cr, cr2))) else cr2 end, case when j then greatest(mx, mx2) else mx2 end, case when j then place else place2 end,
    case when not j then emb2 when emb is null or emb2 is null or len(emb) <> len(emb2) then emb else list_transform(list_zip(emb, emb2), lambda q: ((q[1]::double + q[2]::double) / 2)::float) end,
    case when j then mf + 1 else 1 end, not j, case when j then null else dt2 end
  from (select *, least(e - s, e2 - s2) < 5000 or (not coalesce(why in ('scene_change', 'motion_spike') or why2 in ('scene_change', 'motion_spike'), false) and cr = cr2 and place is not distinct from place2
      and case when emb is null or emb2 is null or len(emb) <> len(emb2) or len(emb) = 0 then true else d1 < 1e-20 or d2 < 1e-20 or least(greatest((1 - d12 / sqrt(d1) / sqrt(d2)) / 2, 0), 1) < 1 - 0.8 end) j
    from (select *, {_dot('emb::double[]', 'emb::double[]')} d1, {_dot('emb2::double[]', 'emb2::double[]')} d2, case when len(emb) = len(emb2) then {_dot('emb::double[]', 'emb2::double[]')} end d12
      from (select r.*  exclude (k), x.k, x.start_time_ms s2, x.end_time_ms e2, x.boundary_reason why2, x.confidence conf2, x.importance imp2, x.event_type typ2, x.cr cr2, x.max_characters_seen mx2, x.location_label place2,
          x.event_embedding emb2, x.dialogue_text dt2 from r join x on x.video_id = r.video_id and x.k = r.k + 1)))),
h as (select * from r qualify coalesce(lead(fresh) over (partition by video_id order by k), true))
select video_id, (row_number() over (partition by video_id order by s) - 1)::int as event_id, s as start_ms, e as end_ms, why as boundary_reason, round(conf, 9) as confidence, round(imp, 9) as importance, typ as event_type,
  case when len(cr) > 0 then array_to_string(cr, ',') end as counts, mx as max_characters_seen, place as location_label,
  md5(array_to_string(list_transform(emb, lambda q: round(q::double * 1e4)::bigint), ',')) as embedding, mf as merged_from, dt as dialogue_text,
  typ || ' event in ' || coalesce(place, 'unknown') || ', ' || case when mx is null then 'character data unavailable' when mx = 0 then 'no people detected' when mx = 1 then '1 person present' else mx || ' people present' end as summary from h""",
    "t6a_should_merge": f"""with {EV}, x as (select a.video_id, a.event_id, a.boundary_reason r1, b.boundary_reason r2, list_sort(coalesce(a.character_count_range, [])) c1, list_sort(coalesce(b.character_count_range, [])) c2,
  a.location_label l1, b.location_label l2, a.event_embedding::double[] e1, b.event_embedding::double[] e2 from ev a join ev b on b.video_id = a.video_id and b.event_id = a.event_id + 1)
select video_id, event_id, not coalesce(r1 in ('scene_change', 'motion_spike') or r2 in ('scene_change', 'motion_spike'), false) and c1 = c2 and l1 is not distinct from l2
  and case when e1 is null or e2 is null or len(e1) <> len(e2) or len(e1) = 0 then true when {_dot('e1', 'e1')} < 1e-20 or {_dot('e2', 'e2')} < 1e-20 then true
    else least(greatest((1 - {_dot('e1', 'e2')} / sqrt({_dot('e1', 'e1')}) / sqrt({_dot('e2', 'e2')})) / 2, 0), 1) < 1 - 0.8 end as merges from x""",
    "j7_chain": f"with {EV} select video_id, event_id as src, lead(event_id) over (partition by video_id order by event_id) as dst from ev qualify dst is not null",
    "j6_rows": f"with {TF}, {EV}, {J6} select video_id, event_id, count(*) as n, round(avg(m), 9) as motion from ms group by 1, 2",
    "t9_split": f"""with {TF}, {EV}, {J6},
pk as (select video_id, event_id, arg_max(t, (n, -t)) top, arg_max(t, (n, -t)) filter (t <> start_time_ms) second_top, count(*) k from ms group by 1, 2),
x as (select ev.*, case when end_time_ms - start_time_ms > 20000 and q <> start_time_ms and q <> end_time_ms then q end q from ev left join (select *, case when false then 0 end z from pk) using (video_id, event_id),
  lateral (select case when top = start_time_ms and k > 2 then second_top else top end q)),
y as (select ms.video_id, ms.event_id, avg(n) filter (t <= q) n1, avg(n) filter (t > q) n2, count(*) filter (t > q) c from ms join x on x.video_id = ms.video_id and x.event_id = ms.event_id group by 1, 2),
z as (select x.*, n1, n2, case when c > 0 then q end h from x left join y using (video_id, event_id))
select video_id, event_id, 0 as part, start_time_ms, end_time_ms, round(importance, 9) as importance, boundary_reason from z where h is null
union all select video_id, event_id, 1, start_time_ms, h, round(n1, 9), 'force_split_max_duration' from z where h is not null
union all select video_id, event_id, 2, h, end_time_ms, round(n2, 9), 'force_split_continuation' from z where h is not null""",
    "a14_keyframes": f"""with {TF}, {EV}, {J6}
select video_id, event_id, 'lowest_blur' as how, arg_min(s, (m, s)) as key_frame from ms group by 1, 2
union all select video_id, event_id, 'center', list(s order by s)[count(*) // 2 + 1] from ms group by 1, 2
union all select video_id, event_id, 'highest_novelty', arg_min(s, (-n, s)) from ms group by 1, 2
union all select video_id, event_id, 'most_motion', arg_min(s, (-m, s)) from ms group by 1, 2""",
    "j5_reference": f"""with x as (select vec_id, label, unnest(embedding)::double v, unnest(range(64)) i from embeddings),
g as (select label, i, avg(v)::float::double r from x group by 1, 2),
d as (select vec_id, g.label, sqrt(sum((v - r) ** 2)) d from x join g using (i) group by 1, 2)
select vec_id, case when min(d) < 0.9 then printf('name %02d', arg_min(label, (d, label))) end as name, round(min(d), 5) as distance from d group by 1""",
    "a23_names": f"with {EV}, {CUE}, {NAMES} select video_id, label, name from rv",
    "l10_boxes": f"""with {TF}, b as (select video_id, s, [[m * 10, n * 10], [n * 10, a * 10], [a * 10, m * 10]] q from tf),
i as (select *, list_transform([[1, 2], [1, 3], [2, 3]], lambda p: greatest(4 - abs(q[p[1]][1] - q[p[2]][1]), 0) * greatest(4 - abs(q[p[1]][2] - q[p[2]][2]), 0)) o from b),
u as (select video_id, s, list_transform(o, lambda x: x / (32 - x) > 0.3) h from i)
select video_id, s as second, (1 + (not h[1])::int + (not (h[2] or (not h[1] and h[3])))::int)::int as boxes from u""",
    "c4_accepted_text": rf"""with x as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') t from documents)
select doc_id, md5(case when t is null or length(t) < 5 or length(t) - length(replace(t, chr(10), '')) > 4 or {_fillers()} then 'fallback' else t end) as accepted from x""",
    "c6_vocatives": f"""with {CUE}, {_stopwords()}, v as (select video_id, cue_idx, {VOC} from cue)
select video_id, cue_idx, coalesce(hi, md) as name, case when hi is not null then 'high' else 'medium' end as confidence from v where coalesce(hi, md) is not null""",
    "l13_vocabulary": f"""with {EV}, x as (select video_id, event_id, lower(trim(summary)) q, {_scenes()} labels, summary from ev)
select video_id, event_id, {_MATCH} as scene, coalesce(try_cast(regexp_extract(summary, '([0-9]+)', 1) as int), 0) as number from x""",
    "l15_prompt": f"""with {TF} select video_id, s as second, 'scene: ' || coalesce(scene_label, 'unknown') || '; action: ' || coalesce(action_label, 'unknown')
  || case when length(dialogue_text) > 0 then '; dialogue: "' || case when length(dialogue_text) > 80 then left(dialogue_text, 80) || '…' else dialogue_text end || '"' else '' end as prompt from tf""",
    "l7_fusion": f"""with x as (select vec_id, embedding::double[] e, case when vec_id % 2 = 0 then list_reverse(embedding)::double[] else list_transform(embedding, lambda q: 0.0::double) end z from embeddings),
y as (select vec_id, list_concat(e, z) b, list_transform(list_zip(e, z), lambda q: (q[1] + q[2]) / 2) m from x)
select vec_id, len(b)::int as dims, md5(array_to_string(list_transform(b, lambda q: round(q * 1e6)::bigint), ',')) as both, md5(array_to_string(list_transform(m, lambda q: round(q * 1e6)::bigint), ',')) as mean from y""",
    "c9_times": f"""with {CUE} select video_id, cue_idx, {_clock('start_ms')} as clock, {_clock('end_ms')} || printf(',%03d', (floor(end_ms) % 1000)::bigint) as srt, floor(end_ms) as parsed from cue""",
    "c11_event_log": f"""with {EV}, b as (select video_id, event_id, printf('Event %03d', event_id + 1) || chr(10) || {_clock('start_time_ms')} || ' -> ' || {_clock('end_time_ms')} || chr(10) || 'Type: ' || event_type || chr(10)
  || 'Characters: ' || case when len(character_labels) > 0 then array_to_string(character_labels, ', ')
    when max_characters_seen > 0 then array_to_string(list_transform(range(1, max_characters_seen + 1), lambda i: 'Person ' || i), ', ') else 'None' end || chr(10)
  || 'Location: ' || upper(left(coalesce(nullif(location_label, ''), 'Unknown'), 1)) || lower(substr(coalesce(nullif(location_label, ''), 'Unknown'), 2)) || chr(10) || 'Summary: ' || coalesce(nullif(summary, ''), '(no summary)') x from ev),
l as (select video_id, string_agg(x, chr(10) || chr(10) order by event_id) y from b group by 1)
select video_id, length(y)::int as length, md5(y) as digest from l""",
    "c12_event_graph": f"""with {EV}, x as (select *, lead(event_id) over (partition by video_id order by event_id) nx from ev),
c as (select video_id, count(nx)::int edges, md5(coalesce(string_agg(event_id || '-' || nx, ',' order by event_id) filter (nx is not null), '')) chain from x group by 1)
select video_id, event_id, start_time_ms, end_time_ms, event_type, summary, coalesce(nx::varchar, '') as before, 0 as causes, edges, chain from x join c using (video_id)""",
    "s7_subtitle_files": f"with {CUE} select video_id, (row_number() over (partition by video_id order by cue_idx) - 1)::int as cue_idx, floor(start_ms) as start_ms, floor(end_ms) as end_ms, x as text from cue where x is not null",
    "s8_vtt_files": f"with {CUE} select video_id, (row_number() over (partition by video_id order by cue_idx) - 1)::int as cue_idx, floor(start_ms) as start_ms, floor(end_ms) as end_ms, x as text from cue where x is not null",
    "s12_manifest": f"""with {PK} select video_id, frame_id, round(t, 3) as timestamp_ms, fps_used, round(m, 4) as motion_score, sc as scene_change, round(a, 4) as audio_energy, round(n, 4) as novelty_score,
  decision_reason, st as subtitle_text from pk""",
    "s13_manifest_defaults": f"with {PK} select video_id, frame_id, 1e0 as fps_used, '' as decision_reason, coalesce(sc, false) as scene_change from pk",
    "s15_event_rows": f"""with {EV} select video_id, event_id, round(start_time_ms, 1) as start_time_ms, round(end_time_ms, 1) as end_time_ms, round(duration_ms, 1) as duration_ms, round(importance, 4) as importance,
  round(confidence, 4) as confidence, summary, boundary_reason, event_type, max_characters_seen, character_data_available, location_label, len(event_embedding)::int as event_embedding_dim,
  array_to_string(character_count_range, ',') as character_count_range, array_to_string(character_labels, ',') as character_labels,
  array_to_string(list_transform(event_embedding[1:32], lambda q: round(round(q::double, 6) * 1e6)::bigint), ',') as event_embedding from ev""",
    "w11_last_boundary": f"""with {TF}, {SIG}, {DEC} select video_id, s as second, max(case when bnd then s end) over (partition by video_id order by s rows between unbounded preceding and 1 preceding) as last_boundary,
  coalesce(round(conf, 6) >= 0.75, false) as sure from de""",
    "w12_recent_motion": f"""with {TF} select video_id, s as second, array_to_string(list(round(m * 1e6)::bigint) over (partition by video_id order by s rows between 4 preceding and current row), ',') as recent from tf""",
    "f11_audio_features": f"""with {TF}, x as (select video_id, s // 64 idx, s, a - 0.3 v from tf), n as (select *, row_number() over w - 1 j, lag(v) over w p from x window w as (partition by video_id, idx order by s)),
g as (select video_id, idx, count(*) k, sum(v * v) q, sum(case when p is not null and (p < -1e-10) <> (v < -1e-10) then case when j % 8 = 0 then 1 else 2 end else 0 end) z from n group by 1, 2),
m as (select video_id, sqrt(sum(q) / sum(k)) * 5 + 1e-9 l from g group by 1)
select video_id, idx, round(least(sqrt(q / 64) / l, 1), 9) as energy, sqrt(q / 64) < 0.02 as silence, round(z / 144.0, 9) as zero_crossing from g join m using (video_id) where k = 64""",
    "a7_last_image": """with p as (select *, row_number() over (partition by video_id, frame_id order by arrived_at) rn from frame_packet where timestamp_ms is not null and not isnan(timestamp_ms))
select video_id, floor(timestamp_ms / 1000)::bigint as second, arg_max(md5(image.rgb), (timestamp_ms, frame_id)) as image from p where rn = 1 and image is not null group by 1, 2""",
    "j4_seek_images": f"""with {PK}, f as (select video_id, timestamp_ms t, arg_min(md5(image.rgb), frame_id) image from frame_packet where image is not null group by 1, 2)
select pk.video_id, frame_id, f.image as image from pk asof left join f on pk.video_id = f.video_id and pk.t >= f.t""",
    "c8_relabel": f"""with recursive {EV}, {CUE}, {NAMES}, nm as (select *, row_number() over (partition by video_id order by label) k from rv),
st as (select video_id, event_id, 0::bigint k, summary x from ev union all select st.video_id, event_id, nm.k, replace(x, label, nm.name) from st join nm on nm.video_id = st.video_id and nm.k = st.k + 1),
lt as (select video_id, event_id, arg_max_null(x, k) summary from st group by 1, 2),
lb as (select video_id, event_id, unnest(character_labels) l, unnest(range(len(character_labels))) i from ev),
ll as (select lb.video_id, event_id, string_agg(coalesce(rv.name, l), ',' order by i) labels from lb left join rv on rv.video_id = lb.video_id and rv.label = l group by 1, 2)
select ev.video_id, ev.event_id, case when character_labels is null then null else coalesce(labels, '') end as labels, lt.summary as summary from ev left join ll using (video_id, event_id) left join lt using (video_id, event_id)""",
    "a20_boundary_f1": f"""with recursive {TF}, {SIG}, {DEC}, {SEG}, {EV},
pr as (select video_id, list(start_ms order by start_ms) p from se group by 1), tr as (select video_id, list(start_time_ms order by start_time_ms) q from ev group by 1),
b as (select coalesce(pr.video_id, tr.video_id) video_id, coalesce(p, []) p, coalesce(q, []) q from pr full join tr on tr.video_id = pr.video_id),
w as (select video_id, p, q, 0 k, []::double[] used from b
  union all select video_id, p, q, k + 1, case when c is null then used else list_append(used, c) end
  from (select *, list_filter(q, lambda t: abs(t - p[k + 1]) <= 2000 and not list_contains(used, t))[1] c from w where k < len(p))),
f as (select video_id, len(p) n, len(q) m, len(used) tp from w where k = len(p)),
g as (select *, case when n > 0 then tp / n else 0 end pc, case when m > 0 then tp / m else 0 end rc from f)
select video_id, n::bigint as n, m::bigint as m, tp::int as tp, round(pc, 4) as precision, round(rc, 4) as recall, round(case when pc + rc > 0 then 2 * pc * rc / (pc + rc) else 0 end, 4) as f1 from g""",
    "a16_audit": f"""with {PK}, x as (select video_id, (max(t) - min(t)) / 1000 s, 100 * avg(coalesce(sc, false)::int) c, 100 * avg(coalesce(length(st) > 0, false)::int) d, avg(m) m, max(m) mm, 100 * avg(img::int) i from pk group by 1)
select video_id, round(s, 9) as total_seconds, round(c, 9) as pct_scene_change, round(d, 9) as pct_dialogue, round(m, 9) as mean_motion, round(mm, 9) as max_motion, round(i, 9) as pct_image,
  concat_ws(',', case when c = 0 then 'no scene changes' end, case when d = 0 then 'no dialogue' end, case when i = 0 then 'no images' end) as warnings from x""",
    "a18_event_quality": f"""with {EV}, x as (select *, duration_ms / 1000 q from ev) select video_id, count(*) as n_events, round(avg(q), 9) as avg_s, round(min(q), 9) as min_s, round(max(q), 9) as max_s, count(*) filter (q < 5) as short,
  count(*) filter (event_type = 'Dialogue') as n_dialogue, count(*) filter (event_type = 'Action') as n_action, count(*) filter (event_type = 'Transition') as n_transition, count(*) filter (event_type = 'Scene') as n_scene from x group by 1""",
    "a19_chunks": f"with {EV} select video_id, count(*) as n_events, round(avg(duration_ms) / 1000, 9) as avg_s, ceil(max(end_time_ms) / 10000)::bigint as n_chunks, 10e0 as chunk_s, max(end_time_ms) as coverage_ms from ev group by 1",
    "a21_rates": f"with {PK} select video_id, count(*) as kept, round(avg(fps_used), 2) as avg_fps from pk group by 1",
    "a22_percentile": f"with {PK}, x as (select video_id, list(m order by m) l from pk group by 1) select video_id, len(l)::int as n, l[(floor(len(l) * 0.95) + 1)::int] as value_at from x",
}
