"""Invariants: nothing is lost, errors stay, budgets hold, hostile input does no harm."""

import json
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersa.config import Config
from tersa.functions import text as T
from tersa.operators import code, json_tables, logs, prose
from tersa.operators.router import routed
from tersa.pipeline import Pipeline
from tersa.sources import rpc, store
from tersa.streaming import templates


def payload(n=200):
    items = []
    for i in range(n):
        row = {"id": i, "name": f"svc-{i}", "status": "suspended" if i % 7 == 0 else "active", "latency_ms": 20 + i % 9, "meta": {"region": "eu", "tier": "gold"}}
        if i == 117:
            row["latency_ms"] = 9500
        if i == min(50, n - 1):
            row["error"] = "connection timeout to shard 3"
        items.append(row)
    return json.dumps({"items": items})


def log(n=800):
    rng = random.Random(1)
    lines = [f"2026-07-19T10:{i // 60 % 60:02d}:{i % 60:02d}Z INFO GET /api/users/{rng.randrange(9999)} 200 {rng.randrange(90)}ms" for i in range(n)]
    lines.insert(n // 2, "2026-07-19T10:06:40Z ERROR upstream connection refused to db-primary:5432")
    return "\n".join(lines)


PROSE = " ".join(
    ["The report opens here.", "Nothing of note took place.", "A fatal flaw was found in the valve.", "Weather was mild."]
    + [f"Filler sentence number {i} says little." for i in range(6)] + ["The canary release was rolled back.", "It ends here."]
)
SOURCE = "import os\n\n" + "\n".join(
    f"class C{i}:\n    def load(self):\n        a = {i}\n        b = a + 1\n        return b\n\n    def save(self, x):\n        y = x\n        {'return cache.get(y)' if i == 4 else 'return y'}\n" for i in range(10)
)


def blobs(spark, *texts, query=""):
    return spark.createDataFrame([(i, t, query) for i, t in enumerate(texts)], "blob_id int, text string, query string")


def one(frame):
    return frame.first().compressed


def tokens(spark, *texts):
    return [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.token_estimate(F.col("t")).alias("n")).collect()]


def test_routing(spark):
    kinds = [r.content_type for r in routed(blobs(spark, payload(), log(), SOURCE, PROSE, "", "[" * 100_000, '{"a": 1} x')).orderBy("blob_id").collect()]
    assert kinds == ["json", "log", "code", "text", "text", "text", "text"]


def test_lossless_table_keeps_every_row(spark):
    text = payload(50)
    row = json_tables.compress(blobs(spark, text), 100).first()
    before, after = tokens(spark, text, row.compressed)
    assert after < 0.6 * before and all(f"svc-{i}|" in row.compressed for i in range(50))
    assert "#every-row: meta.region=eu | meta.tier=gold" in row.compressed and " key=items " in row.compressed


def test_selection_keeps_errors_outliers_and_ends(spark):
    out = one(json_tables.compress(blobs(spark, payload()), 25))
    assert "connection timeout to shard 3" in out and "9500" in out and "svc-0|" in out and "svc-199|" in out and "rows=25of200" in out
    assert "svc-143" in one(json_tables.compress(blobs(spark, payload(), query="what about svc 143"), 25))


def test_a_lossless_table_loses_nothing(spark):
    big = [{"id": 9007199254740992 + i % 2, "a": i} for i in range(4)]
    holes = [{"a": i, "b": -i} for i in range(9)] + [{}]
    named = [{"a": i, "b": -i, **({'x"y': {"k": [1, "é"]}, "z": True} if i == 3 else {})} for i in range(9)]
    out = [r.compressed for r in json_tables.tabular(blobs(spark, *map(json.dumps, (big, holes, named))), 100).orderBy("blob_id").collect()]
    assert out[0].split("\n") == ["#table cols=id|a rows=4", *(f"{9007199254740992 + i % 2}|{i}" for i in range(4))]
    assert out[1].split("\n")[0] == "#table cols=a|b rows=10" and out[1].split("\n")[-1] == "|" and len(out[1].split("\n")) == 11
    extra = out[2].split("\n")[4]
    assert extra.startswith("3|-3 +") and json.loads(extra[6:]) == {'x"y.k': [1, "é"], "z": True}
    equal = [{"a": i, "b": i % 2 == 0 or 1, "c": 1.0 if i else 1} for i in range(4)]
    assert one(json_tables.tabular(blobs(spark, json.dumps(equal)), 9)).startswith("#table cols=a rows=4\n#every-row: b=true | c=1\n")


def test_originals_come_back_without_a_given_store(spark):
    pipe = Pipeline(spark, Config())
    assert pipe.retrieve_one("0" * 24) is None
    for text in (log(), PROSE * 9, payload()):
        out = pipe.compress_blob(text)
        ref = out.split("[ctx-ref ")[1][:24]
        assert out != text and pipe.retrieve_one(ref) == text
    pipe.purge()
    assert pipe.retrieve_one(ref) == text
    pipe.ttl = -1
    pipe.purge()
    pipe.ttl = 60
    assert pipe.retrieve_one(ref) is None


def outline_by_lines(text):
    """Another way to the outline: headers found by indentation, not by the syntax tree."""
    out, source, inside = [], text.splitlines(), None
    for i, line in enumerate(source):
        depth = (len(line) - len(line.lstrip())) // 4
        if not line.strip() or inside is not None and depth > inside:
            continue
        inside, word = None, line.split()[0]
        if word == "def":
            end = i
            while end + 1 < len(source) and (not source[end + 1].strip() or len(source[end + 1]) - len(source[end + 1].lstrip()) > depth * 4):
                end += 1
            while not source[end].strip():
                end -= 1
            doc = source[i + 1].strip()
            out += [line] + ["    " * (depth + 1) + doc] * doc.startswith('"""') + ["    " * (depth + 1) + f"... # {end - i + 1} lines"]
            inside = depth
        elif word in ("class", "import", "from") or depth == 0 and "=" in line and not word.startswith(("for", "if", "print")):
            out.append(line)
        elif word.startswith('"""') and out and out[-1].startswith("class"):
            out.append(line)
    return out


def test_python_outline_against_indentation():
    from tersa.operators.code import python_outline

    for text in (SOURCE, SOURCE.replace("class C", "LIMIT = 3\n\nclass C", 1).replace("def save(self, x):", 'def save(self, x):\n        """Keeps x."""')):
        got = python_outline(text, "").split("\n")
        assert got[0] == f"# skeleton of {len(text.splitlines())}-line python file (bodies elided)" and got[1:] == outline_by_lines(text)


def test_minify_and_other_json(spark):
    assert one(json_tables.compress(blobs(spark, '{ "a" :  [1,   2 ],    "b" : null  }'), 9)) == '{"a":[1,2],"b":null}'
    assert json_tables.compress(blobs(spark, '{"a":1}', "[1,2]", "not json"), 9).count() == 0


def test_log(spark):
    text = log()
    out = one(logs.compress(blobs(spark, text)))
    before, after = tokens(spark, text, out)
    assert "ERROR upstream connection refused to db-primary:5432" in out and "[x800]" in out and after < 0.15 * before


def test_prose(spark):
    assert "fatal flaw" in one(prose.compress(blobs(spark, PROSE), 0.3))
    assert "canary" in one(prose.compress(blobs(spark, PROSE, query="what happened to the canary"), 0.25))
    assert one(prose.compress(blobs(spark, "One. Two. Three."), 0.1)) == "One. Two. Three."
    assert "omitted…]" in one(prose.compress(blobs(spark, PROSE), 0.3))


def test_code(spark):
    out = one(code.compress(blobs(spark, SOURCE, query="how does the cache get work")))
    assert "return cache.get(y)" in out and "b = a + 1" not in out and "... # 4 lines" in out
    braces = "package a;\n" + "\n".join(f"public class A{i} {{\n        int x = 1;\n{chr(10).join(f"        x += call({k}, x, x + {k});" for k in range(9))}\n}}" for i in range(9))
    assert "lines elided" in one(code.compress(blobs(spark, braces)))


def loop(sizes, savings, before, target, least):
    """Which candidates a sequential pass applies."""
    done = set()
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if before <= target:
            break
        if savings[i] >= least:
            before -= savings[i]
            done.add(i)
    return done


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(-5, 80)), max_size=8), st.integers(0, 400), st.integers(0, 300))
def test_running_sum_is_the_loop(pairs, extra, target):
    sizes, savings = [a for a, _ in pairs], [min(a, b) for a, b in pairs]
    before, least, cum, got = sum(sizes) + extra, 10, 0, set()
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        eff = savings[i] if savings[i] >= least else 0
        if eff and before - cum > target:
            got.add(i)
        cum += eff
    assert got == loop(sizes, savings, before, target, least)


@pytest.fixture()
def conversation():
    say = lambda role, content: {"role": role, "content": content, "id": role}
    return [
        say("system", "be brief " * 300), say("user", "hello"), say("assistant", "hi"), say("tool", log()), say("assistant", "so"), say("tool", payload()),
        say("user", [{"type": "text", "text": "a block " * 400}]), say("user", "which shard timed out?"), say("assistant", "shard 3"),
    ]


def test_conversation(spark, tmp_path, conversation):
    pipe = Pipeline(spark, Config(target_tokens=500, live_messages=2), f"file://{tmp_path}/store")
    done = pipe.compress_messages(conversation)
    assert done.tokens_after < done.tokens_before and done.savings_ratio > 0.5
    assert {t["message_index"] for t in done.transforms} == {3, 5}
    assert all(done.messages[i] == conversation[i] for i in range(9) if i not in (3, 5))
    for t in done.transforms:
        assert pipe.retrieve_one(t["ref"]) == conversation[t["message_index"]]["content"]
        assert t["ref"] in done.messages[t["message_index"]]["content"]
    again = pipe.compress_messages(conversation)
    assert again.messages == done.messages
    under = Pipeline(spark, Config()).compress_messages(conversation)
    assert under.messages == conversation and under.transforms == []
    rows = [(7, i, m["role"], m["content"] if isinstance(m["content"], str) else "") for i, m in enumerate(conversation)]
    frames = pipe.compress(spark.createDataFrame(rows, "conv_id int, idx int, role string, content string"))
    assert frames.messages.count() == 9 and frames.transforms.count() == 2 and frames.totals.first().ratio > 0.5


def test_store(spark, tmp_path):
    originals = spark.createDataFrame([("a",), ("b",), ("é" * 9,), ("a",)], "text string")
    now = F.lit("2026-01-01 00:00:00")
    key = b"0123456789abcdef"
    rows = store.entries(originals.distinct(), now, "salt", key)
    store.save(rows, f"file://{tmp_path}/s")
    back = store.load(spark, f"file://{tmp_path}/s").drop("shard")
    assert not any(b"\xc3\xa9" in r.payload for r in back.collect())
    refs = [r.ref for r in back.orderBy("ref").collect()]
    asked = spark.createDataFrame([(r,) for r in [*refs, "x", "A" * 24, refs[0] + "\n", "0" * 24, None]], "ref string")
    found = store.retrieve(asked, back, now, key=key).collect()
    assert {r.text for r in found if r.text} == {"a", "b", "é" * 9} and sum(r.text is None for r in found) == 5
    late = F.lit("2026-01-01 06:00:01")
    assert store.live(back, late).count() == 0 and store.live(back, F.lit("2026-01-01 06:00:00")).count() == 3
    assert store.newest(back, 2).count() == 2
    newer = rows.withColumn("stored_at", F.lit("2026-01-02").cast("timestamp"))
    assert {str(r.stored_at)[:10] for r in store.merged(back, newer).collect()} == {"2026-01-02"}
    assert T.content_ref(F.lit("a"), "t") is not None


def test_hostile_input(spark):
    nest = "[" * 100_000 + "]" * 100_000
    pipe = Pipeline(spark, Config(max_blob_chars=1000))
    assert pipe.compress_blob("x " * 5000) == "x " * 5000
    assert Pipeline(spark).compress_blob(nest) == nest
    assert Pipeline(spark).compress_blob("") == ""


def test_rpc(spark, tmp_path):
    server = rpc.Server(Pipeline(spark, Config(), f"file://{tmp_path}/store"))
    ask = lambda method, **params: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("ping")["result"] == {} and len(ask("tools/list")["result"]["tools"]) == 3
    assert ask("nothing")["error"]["code"] == -32601 and ask("tools/call", name="no")["error"]["code"] == -32602
    out = ask("tools/call", name="compress", arguments={"text": log()})["result"]["content"][0]["text"]
    ref = out.split("[ctx-ref ")[1][:24]
    assert ask("tools/call", name="retrieve", arguments={"ref": ref})["result"]["content"][0]["text"] == log()
    assert "no content" in ask("tools/call", name="retrieve", arguments={"ref": "zz"})["result"]["content"][0]["text"]
    assert ask("tools/call", name="stats")["result"]["content"][0]["text"].startswith("tokens in: ")
    assert server.handle([1]) is None and server.handle({"method": "notifications/initialized"}) is None


def test_streams_agree_with_batches(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{path}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    query = templates.hourly(stream, "100 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table("hours").collect()}
    finally:
        query.stop()
    assert got == {tuple(r) for r in templates.hourly(events).collect()}


def test_evictions_of_a_stream(spark, tmp_path):
    """Three files, one a batch: the bound by recency as a loop has it, then the time to live by the watermark."""
    rng = random.Random(5)
    files = [[(f"t{rng.randrange(3)}", f"r{rng.randrange(9)}", f"2026-01-0{1 + 3 * k} {i // 60:02d}:{i % 60:02d}:00") for i in range(60)] for k in range(3)]
    files[0] += [("quiet", "q1", "2026-01-01 00:00:00"), ("quiet", "q2", "2026-01-01 00:30:00")]
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, "tenant string, ref string, at string").withColumn("at", F.col("at").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/uses")
    stream = spark.readStream.schema("tenant string, ref string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/uses")
    query = templates.evictions(stream, 4, 86400).writeStream.outputMode("update").format("memory").queryName("gone").start()
    try:
        query.processAllAvailable()
        got = [tuple(r) for r in spark.table("gone").collect()]
    finally:
        query.stop()
    first = {}
    for tenant, ref, at in files[0]:
        first.setdefault(tenant, {})[ref] = at
    out = {(t, r) for t, uses in first.items() for r in sorted(uses, key=lambda r: (uses[r], r))[:-4]}
    assert {(t, r) for t, r, why in got if why == "capacity"} >= out
    assert {(t, r) for t, r, why in got if why == "ttl"} >= {("quiet", "q1"), ("quiet", "q2")}


def test_a_cipher_of_ones_own(spark, tmp_path):
    flip = lambda c: F.unhex(F.reverse(F.hex(c)))
    pipe = Pipeline(spark, Config(), f"file://{tmp_path}/store", cipher=(flip, flip))
    ref = pipe.compress_blob(log()).split("[ctx-ref ")[1][:24]
    assert pipe.retrieve_one(ref) == log()
    raw = store.load(spark, f"file://{tmp_path}/store").first().payload
    assert bytes(raw) != log().encode() and (tmp_path / "store").stat().st_mode & 0o077 == 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """The registry imports without tersa.llm and corpus_pipeline."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tersa", tmp_path / "tersa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code_ = "import __spark_entry__ as e; q = e.queries(); assert 'savings' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code_], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0
