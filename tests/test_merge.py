import random

import pytest
from pyspark.sql import functions as F

from stellwerk.operators.merge import also_seen_on, merge, outcomes
from stellwerk.streaming.ingest import ARRIVAL, Companion, StreamingMerge, stream_of

SCHEMA = "seq bigint, job_id string, source string, title string, company string, city string, description string, apply_url string"


def sequential(arrivals):
    """The rule, one arrival after the other."""
    rows, key_of, said = {}, {}, []
    for seq, job, source, title, company, city, text, url in arrivals:
        key = key_of.setdefault(job, (title, company, (city or "").split(",")[0]))
        if job in rows:
            rows[job]["last"] = seq
            said.append((seq, "duplicate"))
            continue
        twin = next((r for r in rows.values() if r["key"] == key and r["source"] != source), None)
        if twin:
            twin["last"] = seq
            if source not in twin["also"]:
                twin["also"].append(source)
            if not (twin["text"] or "").strip() and (text or "").strip():
                twin["text"] = text
            if not twin["url"] and url:
                twin["url"] = url
            said.append((seq, "duplicate"))
        else:
            rows[job] = {"key": key, "source": source, "text": text, "url": url, "also": [], "first": seq, "last": seq}
            said.append((seq, "new"))
    return rows, said


def made_up(seed, n=120):
    r = random.Random(seed)
    kinds = {f"j{k}": (r.choice("AB"), r.choice(["x", None])) for k in range(20)}
    out = []
    for seq in range(n):
        job = f"j{r.randrange(20)}"
        source = "SRC"[int(job[1:]) % 3]
        title, company = kinds[job]
        out.append((seq, job, source, title, company, r.choice(["Ort", "Ort, Fluss"]), r.choice([None, "", " ", f"text {seq}"]), r.choice([None, "", f"u{seq}"])))
    return out


def stored(df):
    return {r.job_id: (r.source, r.description, r.apply_url, r.also_seen_on, r.first_seq, r.last_seq) for r in df.collect()}


def wanted(arrivals):
    return {j: (r["source"], r["text"], r["url"], ",".join(r["also"]) or None, r["first"], r["last"]) for j, r in sequential(arrivals)[0].items()}


@pytest.mark.parametrize("seed", range(6))
def test_set_form_is_the_sequence(spark, seed):
    arrivals = made_up(seed)
    df = spark.createDataFrame(arrivals, SCHEMA).repartition(5)
    assert stored(merge(df)) == wanted(arrivals)
    assert {r.job_id: r.also_seen_on for r in also_seen_on(df).collect()} == {j: w[3] for j, w in wanted(arrivals).items() if w[3]}
    assert {(r.seq, r.outcome) for r in outcomes(df).collect()} == set(sequential(arrivals)[1])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merge(df).count() == 0 and outcomes(df).count() == 0


def test_stream_is_batch(spark, tmp_path):
    arrivals = made_up(77, 200)
    df = spark.createDataFrame(arrivals, SCHEMA)
    df.repartitionByRange(5, "seq").write.parquet(str(tmp_path / "in"))
    state = StreamingMerge(spark, str(tmp_path / "state"))
    state.run(stream_of(spark, str(tmp_path / "in"), df.select(*ARRIVAL), files=2))
    # Files need not come in order of arrival; the result must not depend on it.
    assert stored(state.jobs()) == wanted(arrivals)
    before = stored(state.jobs())
    more = [(1000 + k, *a[1:]) for k, a in enumerate(made_up(78, 30))]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state.run(stream_of(spark, str(tmp_path / "in"), df.select(*ARRIVAL), files=2))
    assert stored(state.jobs()).keys() >= before.keys()


def test_companion_asks_once(spark, tmp_path):
    rows = [(k, f"j{k % 3}", "A", "t", "c", "o", f"text {k % 2}", None) for k in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartitionByRange(4, "seq").write.parquet(str(tmp_path / "in"))
    companion = Companion(spark, str(tmp_path / "state"), lambda prompts: [ValueError("no") if p == "text 1" else {"n": len(p)} for p in prompts])
    companion.run(stream_of(spark, str(tmp_path / "in"), df, files=1))
    got = companion.answers().collect()
    assert len(got) == 6 and {r.problem for r in got} == {None, "no"}


def test_companion_keeps_what_the_rules_allow(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "A", "t", "c", "o", "good", None), (2, "b", "A", "t", "c", "o", "bad", None)], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    rules = lambda answer: F.when(F.get_json_object(answer, "$.n") < 4, "too short")
    companion = Companion(spark, str(tmp_path / "state"), lambda prompts: [{"n": len(p)} for p in prompts], rules)
    companion.run(stream_of(spark, str(tmp_path / "in"), df, files=1))
    assert {(r.job_id, r.answer, r.problem) for r in companion.answers().collect()} == {("a", '{"n": 4}', None), ("b", None, "too short")}


def test_arrivals_are_read_twice_at_most(spark, tmp_path):
    spark.createDataFrame(made_up(1), SCHEMA).write.parquet(f"{tmp_path}/a")
    for made in (outcomes, merge):
        plan = made(spark.read.parquet(f"{tmp_path}/a"))._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
        # One more scan is behind the materialised ids.
        assert plan.count("FileScan parquet") == 1


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    state = StreamingMerge(spark, str(tmp_path), buckets=32)
    first = [(k, f"A:{k}", "A", f"t{k}", "c", "o", "text " * 20, None) for k in range(300)]
    state.apply(spark.createDataFrame(first, SCHEMA), 0)
    # One known id seen again, and one new id of another source with a known identity.
    later = [(300, "A:5", "A", "t5", "c", "o", "x", None), (301, "B:1", "B", "t7", "c", "o", "y", "u")]
    state.apply(spark.createDataFrame(later, SCHEMA), 1)
    assert all(len([n for n in state.names(f"{tmp_path}/{t}/batch=00000001") if n.startswith("bucket=")]) <= 2 for t in state.TABLES)
    want = stored(merge(spark.createDataFrame(first + later, SCHEMA)))
    assert stored(state.jobs()) == want
    # Run again, a batch changes nothing; an earlier number that comes late may move an id to another identity.
    state.apply(spark.createDataFrame(later, SCHEMA), 1)
    assert stored(state.jobs()) == want
    late = [(-1, "A:9", "A", "t7", "c", "o", None, None)]
    state.apply(spark.createDataFrame(late, SCHEMA), 2)
    state.compact(keep=1)
    assert stored(state.jobs()) == stored(merge(spark.createDataFrame(first + later + late, SCHEMA)))
    assert state.names(f"{tmp_path}/manifest") == ["batch=00000002"]
