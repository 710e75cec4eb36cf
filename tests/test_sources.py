"""Messages, tables, exports and reports."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from spans import at, frame, misbehaving_run, span
from spanloom.operators import protocols, reports
from spanloom.operators.assemble import assemble
from spanloom.operators.summary import run_summaries
from spanloom.plans.scoring import score
from spanloom.sources import exports, messages, tables
from spanloom.sources.tables import SpanStore
from spanloom.sources.versions import Part, Version, VersionedTable, merge_groups, small_groups

GOOD = {
    "trace_id": "run-7",
    "span_id": "step-3",
    "parent_span_id": None,
    "service_name": "harbour",
    "agent_name": "pilot",
    "step_type": "llm_call",
    "name": "plan berth",
    "start_time": "2025-03-14T09:30:00+00:00",
    "end_time": "2025-03-14T09:30:01.500000+00:00",
    "duration_ms": 1500.0,
    "status": "ok",
    "error_message": None,
    "model": "tiny-1",
    "tokens_in": 77,
    "tokens_out": 5,
    "cost_usd": 0.0375,
    "attributes": {"quay": "north", "ship": {"flag": "red", "draught": 4}},
    "redacted": True,
}
REQUIRED = ("trace_id", "span_id", "service_name", "agent_name", "step_type", "name", "start_time", "status")


def without(field):
    return {k: v for k, v in GOOD.items() if k != field}


# Message, and the reason it is refused or what it must hold.
CASES = {
    "whole": (GOOD, {"duration_ms": 1500.0, "tokens_in": 77, "cost_usd": 0.0375, "redacted": True, "parent_span_id": None}),
    "least": ({k: GOOD[k] for k in REQUIRED}, {"tokens_in": 0, "cost_usd": 0.0, "attributes": "{}", "redacted": False, "end_time": None}),
    "texts": ({**GOOD, "tokens_in": "10", "cost_usd": "0.5"}, {"tokens_in": 10, "cost_usd": 0.5}),
    "spaced": ({**GOOD, "tokens_in": " 1_000 ", "cost_usd": " 1e-3 "}, {"tokens_in": 1000, "cost_usd": 0.001}),
    "cut": ({**GOOD, "tokens_in": 10.7, "tokens_out": True}, {"tokens_in": 10, "tokens_out": 1}),
    "open": ({**GOOD, "end_time": None}, {"end_time": None}),
    "naive": ({**GOOD, "start_time": "2025-03-14T09:30:00"}, {"start_time": at(0)}),
    "zulu": ({**GOOD, "start_time": "2025-03-14T09:30:00Z"}, {"start_time": at(0)}),
    "basic": ({**GOOD, "start_time": "20250314T093000"}, {"start_time": at(0)}),
    "offset": ({**GOOD, "start_time": "2025-03-14T11:30:00+02:00"}, {"start_time": at(0)}),
    "no attributes": ({**GOOD, "attributes": None}, {"attributes": "null"}),
    "quoted flag": ({**GOOD, "redacted": "false"}, {"redacted": True}),
    "flag off": ({**GOOD, "redacted": False}, {"redacted": False}),
    "flag zero": ({**GOOD, "redacted": 0}, {"redacted": False}),
    "odd step": ({**GOOD, "step_type": "nap"}, {"step_type": "nap"}),
    "null tokens": ({**GOOD, "tokens_in": None}, "tokens_in: not an integer"),
    "fraction text": ({**GOOD, "tokens_in": "10.5"}, "tokens_in: not an integer"),
    "negative": ({**GOOD, "tokens_out": -1}, "tokens_out: out of range"),
    "null cost": ({**GOOD, "cost_usd": None}, "cost_usd: not a number"),
    "word cost": ({**GOOD, "cost_usd": "much"}, "cost_usd: not a number"),
    "number time": ({**GOOD, "start_time": 20260101}, "start_time: not a timestamp"),
    "bad end": ({**GOOD, "end_time": "later"}, "end_time: not a timestamp"),
    "array": ([GOOD], "not a JSON object"),
    "null": (None, "not a JSON object"),
    "text": ("hello", "not a JSON object"),
    **{f"no {f}": (without(f), f"{f}: missing") for f in REQUIRED},
    **{f"null {f}": ({**GOOD, f: None}, f"{f}: missing") for f in REQUIRED},
}


def test_decoding(spark):
    names = list(CASES)
    rows = [(json.dumps(CASES[n][0]), i) for i, n in enumerate(names)]
    rows += [("{broken", len(names)), (None, len(names) + 1)]
    got = {r["seq"]: r for r in messages.decode(spark.createDataFrame(rows, "value string, offset long")).collect()}
    for i, n in enumerate(names):
        want = CASES[n][1]
        if isinstance(want, str):
            assert got[i]["reason"] == want, n
        else:
            assert got[i]["reason"] is None, (n, got[i]["reason"])
            for field, value in want.items():
                assert got[i][field] == value, (n, field, got[i][field])
    assert got[len(names)]["reason"] == got[len(names) + 1]["reason"] == "not a JSON object"
    assert json.loads(got[0]["attributes"]) == GOOD["attributes"]


def test_strict_decoding_checks_the_enums(spark):
    rows = [(json.dumps({**GOOD, "step_type": "nap"}),), (json.dumps({**GOOD, "status": "meh"}),), (json.dumps(GOOD),)]
    decoded = messages.decode(spark.createDataFrame(rows, "value string"), strict=True)
    assert sorted(str(r["reason"]) for r in decoded.collect()) == ["None", "status: unknown", "step_type: unknown"]


def test_attributes_that_are_no_json_are_sent_as_text(spark):
    texts = ["plain words", '{"a":1,"a":2}', '{"a":1}']
    sent = exports.span_messages(frame(spark, [span("t", f"s{i}", None, i, attributes=x) for i, x in enumerate(texts)]))
    got = {json.loads(r["value"])["span_id"]: json.loads(r["value"])["attributes"] for r in sent.collect()}
    assert got == {"s0": texts[0], "s1": texts[1], "s2": {"a": 1}}


def test_sent_spans_decode_to_themselves(spark):
    rows = [r | {"ingested_at": at(0), "attributes": '{"a":{"b":[1,null]}}'} for r in misbehaving_run()]
    spans = frame(spark, rows)
    sent = exports.span_messages(spans)
    assert {bytes(r["key"]) for r in sent.collect()} == {b"bad"}
    back = messages.good_spans(messages.decode(sent))
    skip = ("ingested_at", "seq")
    assert back.drop(*skip).exceptAll(spans.drop(*skip)).count() == 0
    assert back.count() == len(rows)


def test_span_table(spark, tmp_path):
    rows = misbehaving_run("b") + [span("a", "x", None, 86_400_000, attributes=""), span("a", "y", None, 5)]
    path = str(tmp_path / "spans")
    tables.write_spans(frame(spark, rows), path)
    assert tables.read_spans(spark, path).count() == len(rows)
    assert tables.read_spans(spark, path, since="2025-03-15").count() == 1
    # Bounds that choose runs bring the part before midnight too.
    assert tables.read_runs(spark, path, "2025-03-15", "2025-03-15").count() == 2
    # No day holds a span without a start.
    tables.write_spans(frame(spark, [span("a", "u", None, None)]), path)
    assert tables.read_spans(spark, path, since="2025-03-15").count() == 1
    assert tables.read_spans(spark, path, since="2025-03-15", undated=True).count() == 2
    got = tables.spans_of_run(tables.read_spans(spark, path, since="2025-03-14"), "a").collect()
    assert [r["span_id"] for r in got] == ["y", "x"] and got[1]["attributes"] == {}
    plan = tables.read_spans(spark, path).where("trace_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(trace_id), EqualTo(trace_id,a)]" in plan


def test_long_runs_are_read_whole(spark, tmp_path):
    day = 86_400_000
    rows = [span("a", f"s{n}", None, n * day) for n in (0, 4, 9)] + [span("b", "x", None, 0), span("a", "u", None, None), span("c", "y", None, 12 * day)]
    path = str(tmp_path / "spans")
    tables.write_spans(frame(spark, rows), path)
    got = tables.read_runs(spark, path, "2025-03-18", "2025-03-18").collect()
    assert sorted(r["span_id"] for r in got) == ["s0", "s4", "s9", "u"]
    assert tables.read_runs(spark, path, "2024-01-01", "2024-01-02").count() == 0


def test_node_table_keeps_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "nodes")
    tables.ensure_node_table(spark, path)
    tables.ensure_node_table(spark, path)
    assert tables.read_nodes(spark, path).count() == 0
    rows = [span("t", "root", None, 0, duration_ms=None), span("t", "c1", "root", 1), span("t", "g1", "c1", 2), span("t", "c2", "root", 3)]
    nodes = assemble(frame(spark, rows))
    tables.write_nodes(nodes.withColumn("name", F.lit("old")), path, "2026-01-01 00:00:00")
    tables.write_nodes(nodes, path, "2026-01-02 00:00:00")
    got = tables.read_nodes(spark, path).orderBy("order_index").collect()
    assert [(r["span_id"], r["depth"], r["name"], r["duration_ms"]) for r in got] == [
        ("root", 0, "step", 0.0), ("c1", 1, "step", 0.0), ("g1", 2, "step", 0.0), ("c2", 1, "step", 0.0),
    ]
    table = tables.node_table(spark, path)
    assert table.read().count() == 8
    merged = tables.compact_nodes(spark, path)
    assert table.read().count() == 4 and table.read(merged - 1).count() == 8
    assert tables.read_nodes(spark, path).orderBy("order_index").collect() == got
    # A batch that is tried again is not stored twice; a third version wins.
    newest = nodes.where("span_id = 'g1'").withColumn("name", F.lit("new"))
    assert tables.write_nodes(newest, path, "2026-01-03 00:00:00", "watch", 4) == merged + 1
    assert tables.write_nodes(newest, path, "2026-01-03 00:00:00", "watch", 4) is None
    assert [r["name"] for r in tables.read_nodes(spark, path).orderBy("order_index").collect()] == ["step", "step", "new", "step"]
    assert [r["name"] for r in tables.read_nodes(spark, path, 1).orderBy("order_index").collect()] == ["old"] * 4


NUMBERS = T.StructType([T.StructField("n", T.LongType())])


def numbers(table):
    return sorted(r.n for r in table.read().collect())


def test_versions_of_a_table(spark, tmp_path):
    """Two writers at once, a write that dies half-way, and what vacuum leaves."""

    table, rows = VersionedTable(spark, str(tmp_path / "t"), NUMBERS), lambda *n: spark.createDataFrame([(i,) for i in n], NUMBERS)
    assert table.versions() == [] and numbers(table) == []
    assert table.append(rows(1, 2)) == 0

    # Another writer commits between the look at the newest version and the commit.
    raced = []

    def change(now):
        if not raced:
            raced.append(VersionedTable(spark, table.path, NUMBERS).append(rows(3)))
        return Version((*now.parts, part), now.batches)

    part = table.write_part(rows(4))
    assert numbers(table) == [1, 2]  # written, in no version
    assert table.commit(change) == 2 and raced == [1]
    assert numbers(table) == [1, 2, 3, 4] and sorted(r.n for r in table.read(1).collect()) == [1, 2, 3]

    lost = table.write_part(rows(99))  # its writer dies here
    old = table.version().parts
    assert table.replace(old[:2], rows(1, 2, 3)) == 3
    with pytest.raises(RuntimeError, match="another writer"):
        table.replace(old[:2], rows(0))
    assert numbers(table) == [1, 2, 3, 4]
    assert table.append(rows(), "s", 0) == 4 and table.append(rows(7), "s", 0) is None
    assert table.vacuum(keep=1) == 0  # young folders stay
    assert table.vacuum(keep=1, grace_seconds=0) == 5
    assert table.versions() == [4] and numbers(table) == [1, 2, 3, 4]
    assert lost.folder not in {p.folder for p in table.version().parts}


def test_small_parts_are_grouped_by_size():
    part = lambda name, size, day: Part(name, 1, size, 1, day, day)
    parts = (part("a", 60, "2026-01-01"), part("b", 50, "2026-01-02"), part("c", 30, "2026-01-03"), part("d", 100, "2026-01-01"), part("e", 99, "2026-01-09"))
    groups = small_groups(parts, 100)
    assert [[p.folder for p in g] for g in groups] == [["a", "c"]]
    assert part("a", 1, "2026-01-05").may_hold("2026-01-05", None) and not part("a", 1, "2026-01-05").may_hold(None, "2026-01-04")


def test_large_parts_of_the_same_days_are_merged_once(spark, tmp_path):
    """Batches above the target's size still become one part, and that part stays as it is."""

    store = SpanStore(spark, str(tmp_path / "store"), target_bytes=1)
    for batch in range(3):
        rows = [span("t", f"{batch}{i}", None, i, seq=i, ingested_at=at(0)) for i in range(4)]
        store.append(frame(spark, rows).selectExpr("*", "cast(null AS string) AS value", "cast(null AS string) AS reason"), "s", batch)
    assert len(store.table.version().parts) == 3
    assert len(store.compact()) == 1 and len(store.table.version().parts) == 1
    assert store.spans().count() == 12 and store.compact() == []

    part = lambda name, size, first, last, merged=False: Part(name, 1, size, 1, first, last, merged=merged)
    apart = (part("a", 80, "01", "02"), part("b", 90, "02", "03"), part("c", 200, "05", "05"), part("d", 30, "06", "06"), part("e", 40, "08", "08"), part("f", 150, "01", "09", True))
    assert [[p.folder for p in g] for g in merge_groups(apart, 100)] == [["a", "b"], ["d", "e"]]


def nested(nodes):
    """The tree as nested dicts, from flat rows."""

    roots, stack = [], []
    for r in nodes:
        node = {"span_id": r["span_id"], "children": []}
        del stack[r["depth"]:]
        (stack[-1]["children"] if stack else roots).append(node)
        stack.append(node)
    return roots


def names_only(tree):
    return [{"span_id": n["span_id"], "children": names_only(n["children"])} for n in tree]


@pytest.mark.parametrize("part", [5000, 3, 1])
def test_run_json_is_whole_in_any_parts(spark, part):
    rows = [span("t", f"s{i}", f"s{(i - 1) // 2}" if i % 5 else ("gone" if i else None), i, attributes='{"q":"\\"x\\""}') for i in range(11)]
    rows += [span("t", f"d{i}", f"d{i - 1}" if i else None, 100 + i) for i in range(6)]
    spans = frame(spark, rows + [span("empty", None)])
    nodes = assemble(spans)
    docs = exports.run_json(nodes, run_summaries(spans), part)
    text = {}
    for r in docs.orderBy("trace_id", "part").collect():
        text[r["trace_id"]] = text.get(r["trace_id"], "") + r["document"]
    flat = nodes.orderBy("order_index").collect()
    doc = json.loads(text["t"])
    assert names_only(doc["roots"]) == nested(flat)
    assert doc["span_count"] == 17 and doc["summary"]["step_count"] == 17
    assert doc["orphaned_span_ids"] == [r["span_id"] for r in flat if r["orphaned"]]
    assert doc["roots"][0]["attributes"] == {"q": '"x"'}
    assert doc["roots"][0]["start_time"] == "2025-03-14T09:30:00.000000Z"
    assert json.loads(text["empty"])["roots"] == []


def test_run_text_and_findings(spark):
    spans = frame(spark, [span("t", "a", None, 0, duration_ms=12.0, cost_usd=0.5, name="plan"), span("t", "b", "gone", 1, status="error"), span("t", "c", "a", 2)])
    s = score(spans)
    rows = reports.run_text(s.nodes, s.summaries).orderBy("section", "part").collect()
    assert "\n".join(r["text"] for r in rows) == (
        "Trace t -- 3 spans\n" + "=" * 60 + "\n"
        "* agent | tool_call | plan ($0.5000, 12ms)\n"
        "  +- * agent | tool_call | step ($0.0000, ...)\n"
        "x agent | tool_call | step ($0.0000, ...)  [ORPHAN]\n" + "=" * 60 + "\n"
        "cost $0.5000 | 0 tokens (0 in / 0 out)\n"
        "wall-clock 2ms | compute 12ms | 3 steps | 1 agents | 1 errors\n"
        "orphaned spans (missing parent): b"
    )
    from spanloom.operators.detect import finding_documents

    lines = reports.finding_lines(finding_documents(s.nodes, s.findings), s.summaries).collect()
    assert [r["line"] for r in lines] == ["Trace t: clean — no findings."]


def test_strip_parts_join_to_the_whole(spark):
    nodes = tables.node_rows(assemble(frame(spark, misbehaving_run())))
    whole = reports.sequence_strip(nodes).first()["strip"]
    parts = reports.sequence_strip(nodes, part=5).orderBy("part").collect()
    assert len(parts) == 4 and " → ".join(r["strip"] for r in parts) == whole
    assert whole.startswith("[1. decision | clerk | sort mail | 0.0 ms | $0.150000 | ok] → ")


def test_two_runs_may_share_a_label(spark):
    spans = frame(spark, [span("t", "a", None, 0), span("u", "a", None, 0)])
    assert reports.runs_with_label(spans, "svc · ok · 05:30:00").count() == 2
    assert reports.run_detail(tables.node_rows(assemble(spans)), "u").count() == 1


def test_run_selector_needs_an_assembled_tree(spark):
    spans = frame(spark, [span("t", "a"), span("u", "a")])
    nodes = assemble(spans, trace_id="u")
    assert [r["trace_id"] for r in reports.run_selector(spans, nodes).collect()] == ["u"]


def test_stamps(spark):
    df = spark.createDataFrame([("x", "y", None), ("x", "z", "own label")], "a string, b string, label string")
    got = protocols.stamp_handoffs(df, F.col("a"), F.col("b"), task=F.lit("find"), name=F.col("label")).collect()
    assert [r["name"] for r in got] == ["a2a: x -> y", "own label"]
    assert json.loads(got[0]["attributes"]) == {"a2a.from": "x", "a2a.to": "y", "a2a.task": "find"}
    more = F.create_map(F.lit("mcp.tool"), F.lit("lost"), F.lit("k"), F.lit("kept"))
    tool = protocols.stamp_tool_calls(df, F.lit("agent"), F.col("a"), F.col("b"), attributes=more).first()
    assert tool["name"] == "x.y" and json.loads(tool["attributes"]) == {
        "k": "kept", "mcp.server": "x", "mcp.tool": "y", "mcp.transport": "stdio",
    }
