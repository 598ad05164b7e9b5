"""Known inputs and outputs, one block per operator."""

import math

import pytest
from pyspark.sql import functions as F

from reelspark.functions.media_time import duration_label, parse_timestamp, scene_frames
from reelspark.functions.scores import rescale_score
from reelspark.operators import cues as C
from reelspark.operators import drafts as D
from reelspark.operators import export as X
from reelspark.operators import fusion as FU
from reelspark.operators import options as O
from reelspark.operators import rollup as R
from reelspark.operators import sampling as S
from reelspark.operators import selection as SE
from reelspark.operators import tasks as K
from reelspark.operators import timeline as TL
from reelspark.operators import visual as V
from reelspark.sources import media as M
from reelspark.sources import replies as RP
from reelspark.sources import srt as SRT
from reelspark.sources import urls as U

CUE = "project_id long, cue_idx int, start_s double, end_s double, text string"


def cue_table(spark, spans, project=1, text="Source sentence."):
    return spark.createDataFrame([(project, i, float(a), float(b), text) for i, (a, b) in enumerate(spans)], CUE)


def one(spark, value, dtype, fn):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(fn(F.col("x")).alias("y")).first()["y"]


# --- scalars --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw,want",
    [(0.0, 0.0), (1.0, 1.0), (0.85, 0.85), (8.5, 0.85), (85.0, 0.85), (100.0, 1.0), (10.0, 1.0), (0.285, 0.28),
     (math.nan, None), (math.inf, None), (-math.inf, None), (-1.0, None), (101.0, None), (1e9, None)],
)
def test_rescale(spark, raw, want):
    assert one(spark, raw, "double", rescale_score) == want


@pytest.mark.parametrize(
    "token,want",
    [('"00:00:01,500"', 1.5), ('"01:02.5"', 62.5), ("1.5", 1.5), ('"00:60:01"', None), ('"99:00"', None), ('"00:00:1e2"', None),
     ('"00:-1:10"', None), ("null", None), ('"not-time"', None), ("1e999", None), ('"120:00:00.001"', 432000.001)],
)
def test_timestamp(spark, token, want):
    got = one(spark, token, "string", parse_timestamp)
    assert got["seconds"] == want
    assert (got["reason"] is None) == (want is not None)


def test_scene_frames_and_labels(spark):
    df = spark.createDataFrame([(1.0, 1.111), (3.0, 3.151), (0.0, 0.001)], "a double, b double")
    assert [r[0] for r in df.select(scene_frames(F.col("a"), F.col("b"))).collect()] == [3, 5, 1]
    assert one(spark, 0.0, "double", duration_label) == "0:00"
    assert one(spark, 3605.9, "double", duration_label) == "60:05"
    assert one(spark, math.nan, "double", duration_label) == "0:00"


def test_output_dimensions(spark):
    rows = [(3840, 2160, "original", 1920, 1080), (2160, 3840, "original", 1080, 1920), (321, 181, "original", 320, 180),
            (640, 480, "original", 640, 480), (5, 5, "portrait", 1080, 1920), (5, 5, "landscape", 1920, 1080),
            (640, 480, "", 0, 0), (640, 480, "unknown", 0, 0), (1, 480, "original", 0, 0)]
    df = spark.createDataFrame(rows, "width int, height int, aspect string, w int, h int")
    assert all((r["out_w"], r["out_h"]) == (r["w"], r["h"]) for r in O.output_dimensions(df).collect())


def test_duration_profile(spark):
    rows = [(20.0, 20.0, 20.0), (300.0, 150.0, 60.0), (479.0, 150.0, 60.0), (480.0, 300.0, 120.0), (1799.0, 300.0, 120.0),
            (1800.0, 480.0, 240.0), (7200.0, 480.0, 240.0)]
    df = spark.createDataFrame([(i, d, 0, m, t) for i, (d, m, t) in enumerate(rows)], "project_id int, duration double, target int, want_max double, want_target double")
    for r in SE.duration_profile(df).collect():
        assert (r["max_s"], r["target_s"]) == (r["want_max"], r["want_target"])
    grid = spark.createDataFrame([(0, float(d), t) for d in (1, 5, 30, 479, 480, 1800, 7200) for t in (0, 10, 60, 120, 1800)], "project_id int, duration double, target int")
    assert all(r["min_s"] < r["max_s"] for r in SE.duration_profile(grid).collect())


# --- subtitle files --------------------------------------------------------------------------------

SRT_OK = [
    ("﻿1\r\n00:00:00,123 --> 00:01:02,345\r\n你好\r\nworld  \r\n", [(0.123, 62.345, "你好\nworld")]),
    ("00:00:01.000 --> 00:00:02.001\nx", [(1.0, 2.001, "x")]),
    ("﻿", []),
    ("1\n00:00:01,000 --> 00:00:05,000\na\n\n \n2\n00:00:02,000 --> 00:00:03,000\nb\n\n\n", [(1.0, 5.0, "a"), (2.0, 3.0, "b")]),
]
SRT_BAD = [
    b"\xff\xfe", b"1\n", b"hello\n", b"1\n00:00:02,000 --> 00:00:02,000\nx", b"1\n00:00:03,000 --> 00:00:02,000\nx", b"1\n00:60:00,000 --> 00:61:00,000\nx",
    b"1\n-00:00:01,000 --> 00:00:02,000\nx", b"1\n00:00:01,000 --> 00:00:02,000\n", b"1\n00:00:01,000 --> 00:00:02,000\na\x00b", b"x" * ((8 << 20) + 1),
    b"1\n00:00:01,000 --> 00:00:02,000 --> 00:00:03,000\nx",
]


def test_srt_parse(spark):
    docs = [(f"ok{i}", bytearray(t.encode())) for i, (t, _) in enumerate(SRT_OK)] + [(f"bad{i}", bytearray(b)) for i, b in enumerate(SRT_BAD)]
    cues, rejects = SRT.parse_srt(spark.createDataFrame(docs, "path string, content binary"))
    got = {}
    for r in cues.orderBy("path", "cue_idx").collect():
        got.setdefault(r["path"], []).append((r["start_s"], r["end_s"], r["text"]))
    assert got == {f"ok{i}": want for i, (_, want) in enumerate(SRT_OK) if want}
    assert {r["path"] for r in rejects.collect()} == {f"bad{i}" for i in range(len(SRT_BAD))}


def test_srt_files_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(SRT_OK[0][0].encode())
    cues, _ = SRT.parse_srt(SRT.read_srt_files(spark, str(tmp_path)))
    doc = X.to_srt(cues.select(F.lit(1).cast("long").alias("project_id"), "cue_idx", "start_s", "end_s", "text"))[0].first()["srt"]
    assert doc == "1\n00:00:00,123 --> 00:01:02,345\n你好\nworld\n\n"


def test_srt_export_rounding(spark):
    df = spark.createDataFrame([(1, 0, 59.9996, 3600.0014, "a"), (1, 1, 3600.1, 3600.1001, "b")], CUE)
    assert X.to_srt(df)[0].first()["srt"] == "1\n00:01:00,000 --> 01:00:00,001\na\n\n2\n01:00:00,100 --> 01:00:00,101\nb\n\n"


def test_ass_keeps_one_dialogue_line(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.001, "{\\an8}\nDialogue: injected")], CUE)
    dims = spark.createDataFrame([(1, 1080, 1920)], "project_id long, out_w int, out_h int")
    ass = X.to_ass(df, dims)[0].first()["ass"]
    assert ass.endswith("Dialogue: 0,0:00:00.00,0:00:00.01,Default,,0,0,0,,\\{\\\\an8\\}\\NDialogue: injected\n")
    assert ass.count("\nDialogue:") == 1


def test_timeline_cues(spark):
    scenes = [("a", "", 4.0, 6.0, ""), ("b", "", 1.0, 3.0, ""), ("c", "", 4.0, 5.0, "")]
    scene = "array<struct<id:string,label:string,start_s:double,end_s:double,evidence:string>>"
    drafts = spark.createDataFrame([(1, "d", scenes)], f"project_id long, draft_id string, scenes {scene}")
    cues = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 5.0, "B"), (1, 2, 5.0, 7.0, "C")], CUE)
    got = [(r["text"], r["start_s"], r["end_s"]) for r in X.timeline_cues(drafts, cues).orderBy("out_idx").collect()]
    assert got == [("B", 0, 1), ("C", 1, 2), ("A", 2, 3), ("B", 3, 4), ("B", 4, 5)]
    short = spark.createDataFrame([(1, "d", [("a", "", 1.0, 1.111, ""), ("b", "", 3.0, 3.151, "")])], f"project_id long, draft_id string, scenes {scene}")
    at3 = spark.createDataFrame([(1, 0, 3.0, 4.0, "x")], CUE)
    assert X.timeline_cues(short, at3).first()["start_s"] == pytest.approx(0.1)


# --- cues and timeline -----------------------------------------------------------------------------


def test_normalize_rejects(spark):
    raw = "project_id long, seq int, start_s double, end_s double, text string"
    rows = [(1, 0, 1.0, 3.0, "b"), (1, 1, 0.0, 0.5, "a"), (1, 2, 0.05, 2.0, "c"), (2, 0, 1.0, 1.0, "x"), (3, 0, 0.0, 1.0, "　 "), (4, 0, 0.0, 7201.0, "x"),
            (5, 0, 0.0, math.nan, "x"), (6, 0, 0.0, 1.0, "y" * 8001)]
    rows += [(7, i, float(i % 100), float(i % 100) + 1, "z" * 7999) for i in range(1100)]
    kept, rejects = C.normalize_cues(spark.createDataFrame(rows, raw))
    assert [(r["cue_idx"], r["text"], r["duration"]) for r in kept.orderBy("cue_idx").collect()] == [(0, "a", 3.0), (1, "c", 3.0), (2, "b", 3.0)]
    assert {r["project_id"]: r["reason"] for r in rejects.collect()} == {2: "bad_cue", 3: "bad_cue", 4: "bad_cue", 5: "bad_cue", 6: "bad_cue", 7: "too_much_text"}


def test_coverage(spark):
    cues = cue_table(spark, [(0, 0.5), (0.05, 2), (1, 3)])
    spans = spark.createDataFrame([(1, 1, 0.0, 3.0), (1, 2, 3.0, 4.0)], "project_id long, span_id int, start_s double, end_s double")
    assert {r["span_id"]: r["coverage"] for r in TL.speech_coverage(spans, cues).collect()} == {1: 1.0, 2: 0.0}


def test_chunks(spark):
    three = C.chunk_cues(cue_table(spark, [(1800 * i, 1800 * i + 30) for i in range(3)]))
    assert [r["chunk"] for r in three.orderBy("cue_idx").collect()] == [0, 1, 2]
    big = C.chunk_cues(cue_table(spark, [(10 * i, 10 * i + 10) for i in range(100)], text="x" * 2000))
    assert big.count() == 100
    assert big.agg(F.max("chunk")).first()[0] >= 2


@pytest.mark.parametrize("t", [-10.0, 0.0, 2.5, 50.0, 100.0, 150.0, 202.0, 300.0, 1e6])
def test_snap_lands_on_an_edge(spark, t):
    cues = cue_table(spark, [(0, 5), (200, 205)])
    pts = spark.createDataFrame([(1, "start", t, 0), (1, "end", t, 1)], "project_id long, side string, t double, point_id int")
    got = {r["side"]: r["snapped"] for r in C.snap_to_cues(pts, cues).collect()}
    assert got["start"] in (0.0, 200.0) and got["end"] in (5.0, 205.0)
    none = C.snap_to_cues(pts, cues.where("false")).collect()
    assert {r["snapped"] for r in none} == {t}


PROFILE = "project_id long, min_s double, max_s double, hard_max_s double"


def refine(spark, spans, lo, hi, cue_spans=None):
    cues = cue_table(spark, cue_spans or [(10 * i, 10 * i + 10) for i in range(12)])
    items = spark.createDataFrame([(1, i, f"T{i}", float(a), float(b)) for i, (a, b) in enumerate(spans)], "project_id long, ord int, label string, start_s double, end_s double")
    profile = spark.createDataFrame([(1, float(lo), float(hi), 1800.0)], PROFILE)
    rows, report = TL.refine_timeline(items, cues, profile)
    return [(r["start_s"], r["end_s"]) for r in rows.orderBy("ord").collect()], report.first()


@pytest.mark.parametrize(
    "spans,lo,hi,want",
    [
        ([(0.5, 39.5)], 20, 40, [(0, 40)]),
        ([(0, 40), (20, 60)], 20, 90, [(0, 60)]),
        ([(0, 40), (30, 80)], 20, 90, [(0, 40), (40, 80)]),
        ([(0, 10), (10, 20), (20, 30)], 20, 60, [(0, 20), (20, 40)]),
        ([(0, 100)], 20, 30, [(0, 100)]),
        ([(0, 10)], 20, 40, [(0, 20)]),
    ],
)
def test_refine_cases(spark, spans, lo, hi, want):
    got, report = refine(spark, spans, lo, hi)
    assert got == want
    assert report["reason"] is None and report["output"] == len(want)
    assert report["over_tier"] == (1 if spans == [(0, 100)] else 0)


@pytest.mark.parametrize("span", [(40, 0), (200, 300), (math.nan, 10), (-100, -1)])
def test_refine_rejects_bounds(spark, span):
    got, report = refine(spark, [span], 20, 40)
    assert got == [] and report["reason"] == "reversed_or_outside"


def test_refine_coverage(spark):
    assert refine(spark, [(0, 60)], 20, 90, [(0, 1), (59, 60)])[1]["reason"] == "nothing_survived"
    assert refine(spark, [(0, 3)], 1, 3, [(0, 3)])[0] == [(0, 3)]


def test_place_topics(spark):
    topics = spark.createDataFrame([(1, 0, f"topic-{i}", f"T{i}") for i in range(5)], "project_id long, chunk int, topic_id string, title string")
    chunks = spark.createDataFrame([(1, 0, 10.0, 90.0)], "project_id long, chunk int, chunk_start double, chunk_end double")
    rows = [(1, 0, 0, "topic-0", 20.0, 9999.0), (1, 0, 1, "topic-1", -500.0, 30.0), (1, 0, 2, "topic-0", 11.0, 12.0), (1, 0, 3, "nobody", 11.0, 12.0), (1, 0, 4, "topic-2", 30.0, 20.0)]
    placed, rejected = TL.place_topics(topics, spark.createDataFrame(rows, "project_id long, chunk int, row_no int, topic_id string, start_s double, end_s double"), chunks)
    assert {(r["topic_id"], r["start_s"], r["end_s"]) for r in placed.collect()} == {("topic-0", 20.0, 90.0), ("topic-1", 10.0, 30.0)}
    assert rejected.count() == 0


# --- selection, titles, promos ---------------------------------------------------------------------


def test_selection(spark):
    profile = SE.duration_profile(spark.createDataFrame([(1, 100.0, 0)], "project_id long, duration double, target int"))
    for score, kept in ((0.1, 2), (0.99, 6)):
        c = spark.createDataFrame([(1, i, score) for i in range(10)], "project_id long, ord int, score double")
        assert sorted(r["ord"] for r in SE.select_candidates(c, profile).collect()) == list(range(kept))


def test_score_and_title_alignment(spark):
    c = spark.createDataFrame([(1, i, f"c{i}", f"Label {i}") for i in range(6)], "project_id long, ord int, id string, label string")
    scores = [(1, "c0", 8.5, "good"), (1, "c1", None, "why"), (1, "c2", 0.9, ""), (1, "c3", 0.1, "a"), (1, "c3", 0.2, "b"), (1, "zz", 1.0, "x")]
    got = {r["id"]: (r["score"], r["reason"]) for r in SE.align_scores(c, spark.createDataFrame(scores, "project_id long, id string, score double, reason string")).collect()}
    assert got == {"c0": (0.85, "good"), "c1": (0.5, "why"), "c2": (0.9, SE.FALLBACK_REASON), "c3": (0.5, SE.FALLBACK_REASON), "c4": (0.5, SE.FALLBACK_REASON), "c5": (0.5, SE.FALLBACK_REASON)}
    titles = [(1, "c0", "Nice", "hook"), (1, "c1", " ", "h"), (1, "c2", "ok", "y" * 121), (1, "c3", "a", ""), (1, "c3", "b", "")]
    got = {r["id"]: (r["title"], r["hook"]) for r in SE.align_titles(c, spark.createDataFrame(titles, "project_id long, id string, title string, hook string")).collect()}
    assert got == {"c0": ("Nice", "hook"), "c1": ("Label 1", "h"), "c2": ("ok", ""), "c3": ("Label 3", ""), "c4": ("Label 4", ""), "c5": ("Label 5", "")}
    nameless = c.withColumn("label", F.lit(" "))
    assert SE.align_titles(nameless.where("ord = 4"), spark.createDataFrame(titles, "project_id long, id string, title string, hook string")).first()["title"] == "Highlight c4"


def test_promo_replies(spark):
    c = spark.createDataFrame([(p, f"c{i}", "L", float(i), float(i + 1), "E") for p in range(1, 6) for i in range(4)], "project_id long, id string, label string, start_s double, end_s double, evidence string")
    rows = [(1, 0, "c0", "A", "One"), (1, 1, "c1", "B", "Two"), (2, 0, "c9", "A", "x"), (3, 0, "c0", "A", "Same  Hook"), (3, 1, "c1", "B", " same hook\t"),
            (5, 0, "c0", " Title ", ""), (5, 1, "c1", "z", "title")] + [(4, i, f"c{i}", "t", f"h{i}") for i in range(4)]
    plans, rejects = SE.promo_plans(spark.createDataFrame(rows, "project_id long, ord int, candidate_id string, title string, hook string"), c)
    assert {r["project_id"] for r in plans.collect()} == {1}
    assert {r["project_id"]: r["reason"] for r in rejects.collect()} == {2: "unknown_or_unbounded", 3: "repeated_opening", 4: "too_many_plans", 5: "repeated_opening"}


# --- visual ---------------------------------------------------------------------------------------


def test_add_context(spark):
    rows = [(10, 24, 30, 60, 8.5, 26), (20, 26, 30, 60, 18.5, 28), (10, 40, 30, 60, 10, 40), (0.5, 10, 30, 60, 0, 12), (50, 59.5, 30, 60, 48.5, 60), (10, 35, 30, 200, 8.0 - 0.5 + 0.0 + 0.0, 37)]
    rows[-1] = (10, 35, 30, 200, 8.5, 37)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "start_s double, end_s double, target double, duration double, ws double, we double")
    for r in V.add_context(df).collect():
        assert (r["start_s"], r["end_s"]) == (r["ws"], r["we"])


def test_trim_keeps_cited_frames(spark):
    df = spark.createDataFrame([(0.0, 50.0, [10.0, 20.0], 0.0, 60.0, 30.0)], "start_s double, end_s double, frame_times array<double>, win_start double, win_end double, max_s double")
    r = V.trim_events(df).first()
    assert r["end_s"] - r["start_s"] <= 30 and r["start_s"] <= 10 and r["end_s"] >= 20


EVENT = "array<struct<id:string,label:string,start_s:double,end_s:double,evidence:string,kind:string,score:double,selection_reason:string,frame_times:array<double>>>"


def ev(id="a", label="x", start=1.0, end=5.0, evidence="", kind="gameplay", score=0.9, reason="", times=(2.0,)):
    return (id, label, start, end, evidence, kind, score, reason, list(times))


def test_visual_reply_rules(spark):
    frames = [float(i) for i in range(11)]
    cases = {
        1: ([ev(), ev("b", label=" ", kind="", score=None, times=[2.04, 2.0, 9.0])], None),
        2: ([ev(), ev()], "id"), 3: ([ev(id="no id")], "id"), 4: ([ev(label="x" * 121)], "label"), 5: ([ev(score=101.0)], "score"), 6: ([ev(kind="party")], "kind"),
        7: ([ev(start=None)], "time"), 8: ([ev(end=10.5)], "window"), 9: ([ev(end=1.05)], "too_short"), 10: ([ev(times=[])], "citation_count"), 11: ([ev(times=[2.5])], "unknown_frame"),
        12: ([ev(times=[9.0])], "no_supporting_frame"), 13: ([], "no_highlights"), 14: (None, "no_events_array"), 15: ([ev(f"e{i}") for i in range(12)] + [ev("late id!")], None),
    }
    rows = [(k, e, frames, 0.0, 10.0, 30.0) for k, (e, _) in cases.items()]
    events, rejects = V.validate_visual(spark.createDataFrame(rows, f"reply_id int, events {EVENT}, frames array<double>, win_start double, win_end double, max_s double"))
    assert {r["reply_id"]: r["reason"] for r in rejects.collect()} == {k: w for k, (_, w) in cases.items() if w}
    kept = {(r["reply_id"], r["id"]): r for r in events.collect()}
    b = kept[(1, "b")]
    assert (b["label"], b["kind"], b["score"], b["frame_times"]) == ("片段", "unknown", 0.0, [2.0])
    assert sum(1 for k in kept if k[0] == 15) == 12


def test_playable(spark):
    rows = [(1, 0, "menu", 0.99), (1, 1, "gameplay", 0.8), (1, 2, "gameplay", 0.9)] + [(2, i, "other", 0.5) for i in range(20)]
    got = V.playable(spark.createDataFrame(rows, "project_id long, ord int, kind string, score double"))
    assert [r["ord"] for r in got.where("project_id = 1").orderBy("rank").collect()] == [2, 1]
    assert [r["ord"] for r in got.where("project_id = 2").orderBy("rank").collect()] == list(range(6))


def test_downsample(spark):
    frames = spark.createDataFrame([(1, float(i)) for i in range(600)], "project_id long, time_s double")
    for n in (25, 60):
        got = sorted(r["time_s"] for r in S.even_downsample(frames, n).collect())
        assert got == [float(i * 599 // (n - 1)) for i in range(n)]
    assert S.even_downsample(frames.where("time_s < 10"), 25).count() == 10


def test_sample_generators(spark):
    def seconds(d):
        df = spark.createDataFrame([(1, d)], "project_id long, duration double")
        return [r["time_s"] for r in S.second_samples(df).orderBy("time_s").collect()]

    assert seconds(0.0) == [0] and seconds(0.4) == [0] and seconds(1.0) == [0] and seconds(2.1) == [0, 1, 2]
    assert len(seconds(60.0)) == 60 and seconds(math.nan) == [0]
    for d, n, last in [(0.04, 1, 0), (1, 1, 0), (2.05, 1, 0), (2.101, 2, 2), (6, 3, 4), (119, 60, 118), (120, 60, 118), (121, 60, 118.983), (299.84, 60, 294.843), (7200, 60, 7080)]:
        df = spark.createDataFrame([(1, float(d))], "project_id long, duration double")
        got = [r["time_s"] for r in S.sparse_samples(df).orderBy("i").collect()]
        assert (len(got), got[-1]) == (n, last)


def test_fusion_pair(spark):
    schema = "project_id long, ord long, label string, start_s double, end_s double, evidence string, score double, kind string"
    text = spark.createDataFrame([(1, 0, "t", 10.0, 22.0, "said", 0.8, "text")], schema)
    visual = spark.createDataFrame([(1, 0, "v", 12.0, 24.0, "seen", 0.9, "gameplay"), (2, 0, "v", 1.0, 2.0, "", 0.7, "other")], schema)
    got = {r["project_id"]: r for r in FU.fuse_evidence(text, visual).collect()}
    joint, lone = got[1], got[2]
    assert (joint["kind"], joint["start_s"], joint["end_s"], joint["id"]) == ("joint", 10.0, 24.0, "fused-001")
    assert joint["score"] == pytest.approx(0.95) and joint["evidence"] == "字幕：said 画面：seen" and "0.80" in joint["selection_reason"]
    assert (lone["kind"], lone["score"]) == ("visual-only", 0.7)


# --- strict JSON, logs, URLs -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw,reason",
    [
        ('{"value":1}', None), ('```json\n{"value":1}\n```', None), ('```\n{"value":1}\n```', None), ('{"VALUE":1}', None), ("", "empty"), ('{"value":1,"value":2}', "duplicate_key"),
        ('{"value":1,"VALUE":2}', "duplicate_key"), ('{"value":"x"}', "schema_mismatch"), ('{"value":1,"more":2}', "unknown_field"), ('{"value":1} {}', "malformed_json"),
        ('Sure: {"value":1}', "malformed_json"), ('```json\n{"value":1}', "open_fence"), (None, "invalid_utf8"), ("[" * 66 + "]" * 66, "too_deep"), ('{"value":', "malformed_json"), ('{"value":NaN}', "malformed_json"),
        ('{"value":1' + " " * (2 << 20) + "}", "too_large"), ("[" * 100000, "too_deep"),
    ],
)
def test_strict_json(raw, reason):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("value", T.DoubleType())])
    assert RP.check_reply(raw, schema)[1] == reason


def test_reply_tokens_and_split(spark):
    raw = [("a", '[{"topic_id":"t","start":0.5,"end":"00:01:40,000"}]'), ("b", "[{]")]
    ok, bad = RP.ingest_replies(spark.createDataFrame(raw, "reply_id string, raw string"), RP.TIMELINE)
    row = ok.select(F.explode("reply").alias("x")).select(parse_timestamp(F.col("x.start"))["seconds"], parse_timestamp(F.col("x.end"))["seconds"]).first()
    assert tuple(row) == (0.5, 100.0)
    assert [(r["reply_id"], r["reason"]) for r in bad.collect()] == [("b", "malformed_json")]


def test_completions(spark):
    def body(error=None, finish="stop", content='"hi"', extra=""):
        tail = f',"error":{error}' if error is not None else ""
        return f'{{"choices":[{{"finish_reason":"{finish}","message":{{"content":{content}{extra}}}}},{{}}]{tail}}}'

    rows = [("ok", body()), ("noise", body("{}")), ("null", body("null")), ("empty", body('""')), ("err", body('{"code":"x"}')), ("str", body('"bad"')), ("cut", body(finish=" LENGTH ")), ("eos", body(finish="eos")),
            ("refused", body(extra=',"refusal":"no"')), ("blank", body(content='" "')), ("none", '{"choices":[]}'), ("dup", '{"choices":[],"choices":[]}')]
    got = {r["request_id"]: r["reason"] for r in RP.extract_completions(spark.createDataFrame(rows, "request_id string, body string")).collect()}
    assert got == {"ok": None, "noise": None, "null": None, "empty": None, "err": "provider_error", "str": "provider_error", "cut": "unfinished", "eos": None, "refused": "empty_or_refused", "blank": "empty_or_refused", "none": "no_choice", "dup": "no_choice"}


def test_urls(spark):
    good = {
        "https://www.youtube.com/watch?v=abcdefghijk&list=x": "https://www.youtube.com/watch?v=abcdefghijk", "https://youtu.be/abcdefghijk?url=https://evil": "https://www.youtube.com/watch?v=abcdefghijk",
        "https://m.youtube.com/shorts/abcdefghijk": "https://www.youtube.com/watch?v=abcdefghijk", "https://WWW.bilibili.com/video/BV1234567890/?p=3&t=1": "https://www.bilibili.com/video/BV1234567890?p=3",
        "https://bilibili.com/video/av17": "https://www.bilibili.com/video/av17", "https://b23.tv/abcd": "https://b23.tv/abcd",
    }
    bad = ["", "http://youtu.be/abcdefghijk", "https://youtu.be:443/abcdefghijk", "https://u:p@youtu.be/abcdefghijk", "https://127.0.0.1/watch?v=abcdefghijk", "https://youtube.com.evil.com/watch?v=abcdefghijk",
           "https://www.youtube.com/playlist?list=x", "https://www.youtube.com/watch?v=abcdefghijk&v=abcdefghijk", "https://www.youtube.com/watch?v=short", "https://www.bilibili.com/video/BV1234567890?p=0",
           "https://www.bilibili.com/video/BV1234567890?p=1&p=2", "https://www.bilibili.com/video/av0", "https://b23.tv/abcd?x=1", "https://b23.tv/abcd#x", "https://youtu.be/%61bcdefghijk", " https://youtu.be/abcdefghijk",
           "https://youtu.be/abcdefghijk\n", "ftp://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk;x=1", "https://www.youtube.com/watch?v=%zz", "//youtu.be/abcdefghijk", "https:youtu.be/abcdefghijk", "x" * 5000]
    df = U.canonicalize_urls(spark.createDataFrame([(u,) for u in [*good, *bad]], "url string"))
    got = {r["url"]: (r["canonical"], r["reason"]) for r in df.collect()}
    assert {u: got[u][0] for u in good} == good
    assert all(got[u][0] is None and got[u][1] for u in bad)
    assert df.where("needs_resolution").count() == 1
    custom = (U.SiteRule("pages", ("blog.example.net",), "^/en/([0-9]+)/?\\z", "https://blog.example.net/en/"),)
    assert U.canonicalize_urls(spark.createDataFrame([("https://blog.example.net/en/12/?utm=1",)], "url string"), rules=custom).first()["canonical"] == "https://blog.example.net/en/12"


def test_progress_lines(spark):
    lines = ["out_time_us=N/A", "out_time_us=0", "out_time_us=5000000", "out_time_us=4000000", "out_time_us=20000000", "frame=3"]
    log = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "op_id long, seq long, line string").select(
        "op_id", F.timestamp_seconds(F.col("seq")).alias("ts"), "seq", K.line_percent(F.col("line"), F.lit(10.0), F.lit(98.0)).alias("percent"))
    assert [r["percent"] for r in K.monotone_progress(log).orderBy("seq").collect()] == [0, 49, 98]


def test_draft_rules(spark):
    scene = "array<struct<id:string,label:string,start_s:double,end_s:double,evidence:string>>"
    base = dict(project_id=1, draft_id="d", title="T", hook="", scenes=[("s", "l", 0.0, 10.0, "")], aspect="original", layout="fit", crop_x=0.5, title_style="plain", title_template_version=1, title_scale=1.0, title_y=0.12, title_accent=None, revision=1)
    cases = {
        "ok": ({}, None), "edge": ({"scenes": [("s", "l", 0.0, 10.002, "")]}, "scene"), "crop": ({"crop_x": math.nan}, "placement"), "style": ({"title_style": "wild"}, "options"), "none": ({"scenes": []}, "scene_count"),
        "blank": ({"title": " 　"}, "identity"), "template": ({"title_template_version": 4}, "template"), "twin": ({"scenes": [("s", "", 0.0, 1.0, ""), ("s", "", 1.0, 2.0, "")]}, "scene"), "accent": ({"title_accent": "red"}, "accent"), "rev": ({"revision": 0}, "revision"),
    }
    rows = [tuple({**base, **c, "draft_id": k}.values()) for k, (c, _) in cases.items()] + [tuple({**base, "draft_id": "../data"}.values())]
    schema = f"project_id long, draft_id string, title string, hook string, scenes {scene}, aspect string, layout string, crop_x double, title_style string, title_template_version int, title_scale double, title_y double, title_accent string, revision int"
    got = {r["draft_id"]: r["reason"] for r in D.validate_drafts(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 10.0)], "project_id long, duration double")).collect()}
    assert got == {**{k: w for k, (_, w) in cases.items()}, "../data": "identity"}


def test_rollup_states(spark):
    goals = "workflow_id string, goal string, status string, error string, n_drafts int"
    tasks = "workflow_id string, kind string, goal string, seq int, status string, error string"
    g = [(w, goal, st, err, n) for w in ("failed", "requeued", "mixed", "done", "stopped") for goal, st, err, n in (("content", "completed", "", 1), ("highlight", "failed", "boom", 0))]
    g = [x for x in g if not (x[0] in ("done", "stopped") and x[1] == "highlight")]
    g = [(w, a, b, c, 0) if w == "stopped" else (w, a, b, c, n) for w, a, b, c, n in g]
    g = [(w, a, "analyzing", c, n) if w == "stopped" else (w, a, b, c, n) for w, a, b, c, n in g]
    t = [("failed", "analyze", "", 0, "failed", "boom"), ("failed", "export", "content", 1, "completed", ""), ("requeued", "analyze", "", 0, "queued", ""), ("requeued", "export", "content", 1, "completed", ""),
         ("mixed", "analyze", "", 0, "completed", ""), ("mixed", "export", "content", 1, "failed", "gpu"), ("mixed", "export", "highlight", 2, "completed", ""), ("done", "analyze", "", 0, "completed", ""),
         ("done", "export", "content", 1, "completed", ""), ("stopped", "analyze", "", 0, "interrupted", "late")]
    rows = R.rollup_workflows(spark.createDataFrame(g, goals), spark.createDataFrame(t, tasks)).collect()
    assert {r["workflow_id"]: r["workflow_status"] for r in rows} == {"failed": "partial", "requeued": "running", "mixed": "partial", "done": "completed", "stopped": "interrupted"}
    assert {r["workflow_id"]: r["project_status"] for r in rows}["done"] == "exported"


def test_candidate_merge_order(spark):
    s = "workflow_id int, id string, ord int"
    first = R.merge_candidates(spark.createDataFrame([(1, "subtitle-one", 0)], s), spark.createDataFrame([(1, "visual-one", 0)], s))
    assert first.count() == 2
    second = R.merge_candidates(first.drop("part"), spark.createDataFrame([(1, "visual-two", 0)], s))
    assert [r["id"] for r in second.orderBy("part", "ord").collect()] == ["visual-two", "subtitle-one"]


def test_engine_and_probe(spark):
    lines = [(1, 0, '{"type":"progress","stage":"a","percent":5}'), (1, 1, '{"type":"result"}'), (2, 0, '{"type":"result"}'), (2, 1, '{"type":"result"}'), (3, 0, '{"type":"progress","stage":"","percent":5}'),
             (4, 0, '{"type":"progress","stage":"a","percent":101}'), (5, 0, '{"type":"error"}'), (6, 0, "nope"), (7, 0, '{"type":"hello"}'), (8, 0, '{"type":"progress","stage":"a"}')]
    got = {r["job_id"]: r["reason"] for r in M.fold_engine_events(spark.createDataFrame(lines, "job_id int, seq int, line string")).collect()}
    assert got == {1: None, 2: "more_than_one_result", 3: "invalid_progress", 4: "invalid_progress", 5: "error_without_message", 6: "invalid_json", 7: "unknown_event", 8: "no_result"}


def test_scene_moves(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 0, 1), (["a", "b", "c"], 2, 1), (["a", "b", "c"], 5, -1), (["a", "b", "c"], 1, -1)], "s array<string>, i int, d int")
    assert [r[0] for r in df.select(D.move_scene(F.col("s"), F.col("i"), F.col("d"))).collect()] == [["b", "a", "c"], ["a", "b", "c"], ["a", "b", "c"], ["b", "a", "c"]]


# --- paths, bounds, stored timelines --------------------------------------------------------------------


def test_clean_path(spark):
    rows = ["/w/a/b", "/w//a/./b/", "a/../b", "../x", "/w/../../etc", "", "/", "/w/a/.."]
    df = spark.createDataFrame([(r,) for r in rows], "p string").select(M.clean_path(F.col("p"), "/w/"))
    assert [r[0] for r in df.collect()] == ["/w/a/b", "/w/a/b", "/w/b", "/x", "/etc", "/w", "/", "/w"]


def test_engine_paths_outside_reject_the_project(spark):
    schema = "project_id long, seq long, id string, start_s double, end_s double, title string, score double, reason string, hook string, crop_path string"
    rows = [(p, 0, "c", 0.0, 5.0, "", 50.0, "why", None, path) for p, path in enumerate(["/w/a.json", "/w/../x", "/wx/a", "b.json", None, "/w"])]
    projects = spark.createDataFrame([(p, 10.0, "portrait") for p in range(7)], "project_id long, duration double, aspect string")
    drafts, rejects = M.engine_drafts(spark.createDataFrame(rows, schema), projects, "/w")
    assert sorted((r["project_id"], r["crop_path"], r["ratio"], r["hook"]) for r in drafts.collect()) == [(0, "/w/a.json", "9:16", ""), (3, "/w/b.json", "9:16", "")]
    assert {r["project_id"]: r["reason"] for r in rejects.collect()} == {1: "unsafe_crop_path", 2: "unsafe_crop_path", 4: "unsafe_crop_path", 5: "unsafe_crop_path", 6: "no_candidates"}


def test_a_profile_may_not_ask_for_more_than_is_kept(spark):
    c = spark.createDataFrame([(1, 0, 0.9)], "project_id long, ord int, score double")
    profile = spark.createDataFrame([(1, 1, 40)], "project_id long, min_keep int, max_keep int")
    with pytest.raises(Exception, match="largest_keep"):
        SE.select_candidates(c, profile).collect()
    assert SE.select_candidates(c, profile, largest_keep=40).count() == 1


def test_speech_before_edges(spark):
    spans = [(0.0, 2.0), (1.0, 5.0), (1.5, 3.0), (7.0, 8.0), (7.0, 9.5), (9.5, 10.0), (12.0, 13.0)]
    cues = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "project_id long, cue_idx int, start_s double, end_s double")
    said = lambda t: sum(any(a <= q / 4 < b for a, b in spans) for q in range(int(t * 4))) * 250_000
    for r in C.speech_edges(cues).collect():
        assert (r["start_u"], r["end_u"]) == (said(r["start_s"]), said(r["end_s"]))
        later = [a for a, _ in spans if a >= r["end_s"]]
        assert (r["end_next"], r["end_next_u"]) == ((min(later), said(min(later))) if later else (None, None))


def test_a_stored_timeline_is_checked(spark):
    cues = spark.createDataFrame([(p, i, i * 10.0, i * 10.0 + 9, f"c{i}") for p in range(14) for i in range(6)], "project_id long, cue_idx int, start_s double, end_s double, text string")
    good = lambda p: [[p, 1, "text-1", "A", 0.0, 19.0, "c0 c1", 0.0, "text"], [p, 2, "text-2", "B", 20.0, 39.0, "c2 c3", 0.0, "text"]]
    faults = {1: (2, "text-3"), 2: (3, ""), 3: (4, float("nan")), 4: (4, 10.0), 5: (5, 29.5), 6: (6, "c2"), 7: (7, 0.1), 8: (8, "gameplay"), 9: (5, 9.0)}
    rows = []
    for p in range(13):
        two = good(p)
        if p in faults:
            at, value = faults[p]
            two[1][at] = value
        rows += [tuple(r) for r in two]
    schema = "project_id long, ord int, id string, label string, start_s double, end_s double, evidence string, score double, kind string"
    report = spark.createDataFrame([(p, 3 if p == 10 else 2, 1 if p == 11 else 0) for p in range(14)], "project_id long, output int, over_tier int")
    profile = spark.createDataFrame([(p, 15.0, 30.0, 18.0 if p == 12 else 60.0) for p in range(14)], "project_id long, min_s double, max_s double, hard_max_s double")
    got = {r["project_id"]: r["reason"] for r in TL.check_timeline(spark.createDataFrame(rows, schema), report, cues, profile).collect()}
    assert got == {0: None, 1: "id", 2: "label", 3: "bounds", 4: "overlap", 5: "too_short", 6: "evidence", 7: "kind", 8: "kind", 9: "too_short", 10: "count", 11: "over_tier", 12: "too_long", 13: "empty"}


def test_lists_that_are_gathered_have_a_bound(spark):
    goals = spark.createDataFrame([(1, i, "g", "failed", f"e{i}") for i in range(5)] + [(2, 0, "g", "failed", "e")], "workflow_id long, ord int, goal string, status string, error string")
    assert {r["workflow_id"]: (r["status"], r["message"]) for r in R.goal_failures(goals).collect()} == {1: ("invalid", "too_many_goals"), 2: ("failed", "g: e")}
    stages = spark.range(K.MAX_STAGES + 3).select(F.lit(1).alias("run_id"), F.col("id").cast("int").alias("n"), F.concat(F.lit("s"), "id").alias("stage"), F.lit("i").alias("input"), F.lit("d").alias("data"))
    saved = spark.createDataFrame([], "run_id int, stage string, version string, input_hash string, previous string, data_hash string")
    got = K.checkpoint_lineage(stages, saved).groupBy("stale_reason").count().collect()
    assert {r["stale_reason"]: r["count"] for r in got} == {"absent": K.MAX_STAGES, "too_many_stages": 3}
