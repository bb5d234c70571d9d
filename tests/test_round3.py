"""Cases of the third round's findings: each failed before its finding was settled."""
import duckdb

from reelframe.plans.oracles import oracles
from reelframe.plans.queries import QUERIES


def same_as_sql(spark, home, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{home}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, home).toArrow(), c.sql(oracles()[name]).to_arrow_table()
    rows = lambda t: sorted(map(str, zip(*[t[x].to_pylist() for x in sorted(got.column_names)])))
    assert rows(got) == rows(want)
    return got.to_pylist()


def test_a_turn_kind_takes_whole_words_of_any_script(spark, tmp_path):
    texts = {"Doñ a b.": "idea", "Isé x": "idea", "Is x": "question", "do": "question", "cut\nx": "directive", "Iſ x": "idea", "let's go": "directive", "why9 x": "idea", "add-on": "directive"}
    rows = [(i, 3, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = same_as_sql(spark, str(tmp_path), "turn_kinds", ["conversations"])
    assert {r["conv_id"]: [k for k in ("question", "directive", "idea") if r[k]] for r in got} == {i: [k] for i, k in enumerate(texts.values())}


def test_edits_that_share_a_number_stay_apart(spark, tmp_path):
    import datetime as dt

    ids = [i + k for k in (0, 1_000_000, 6_000_000) for i in (0, 3, 4, 5, 6, 8, 10)]
    rows = [(i, dt.datetime(2024, 1, 1), i % 2, "view", 1.0, "") for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["script_id"], r["edit_seq"]) for r in same_as_sql(spark, str(tmp_path), "edits_in_force", ["events"])]
    assert len(got) > len(set(got))


def test_matched_has_difflibs_ratio_and_stops_early():
    import difflib
    import random

    from reelframe.functions.text import Matched, bounded, cut_windows

    deal = random.Random(3)
    words = ["".join(deal.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(deal.randrange(1, 7))) for _ in range(80)]
    for _ in range(120):
        text = [deal.choice(words) for _ in range(deal.randrange(1, 150))]
        at = deal.randrange(len(text))
        quote = " ".join(w if deal.random() < 0.8 else deal.choice(words) for w in text[at : at + deal.randrange(1, 100)])
        for bound, window in bounded(quote, cut_windows(quote, " ".join(text))):
            want, asked = difflib.SequenceMatcher(None, quote, window).ratio(), deal.random()
            found = Matched(quote, window)
            assert found.at_least(0.0) == want <= bound and found.at_least(want) == want and found.at_least(asked) == (want if want >= asked else None)
    short = Matched("abcdefgh" * 20, "x" * 20)
    short.longest = None  # lengths alone tell that it is not enough
    assert short.at_least(0.9) is None


def test_similar_texts_travel_under_short_names_and_lose_no_pair(spark, monkeypatch):
    from reelframe.operators import similarity

    rows = spark.createDataFrame([(1, "one of these lines"), (1, "one of those lines"), (1, "another thing altogether")], "k int, text string")
    plain = similarity.distinct_texts
    assert dict(plain(rows, ["k"], "text").dtypes)["id"] == "bigint"
    monkeypatch.setattr(similarity, "distinct_texts", lambda *x: plain(*x).selectExpr("k", "text", "0L as id"))  # all share a name
    found = {(r["left_text"], r["right_text"]) for r in similarity.similar_pairs(rows, rows, ["k"], "text", 0.8).collect()}
    assert len(found) == 5


def test_pairs_are_dealt_over_as_many_tasks_as_asked_and_made_once(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    from reelframe.operators import graph

    rows = spark.createDataFrame([(o, s) for o in range(40) for s in range(o % 5)], "o long, s long")
    plain = {tuple(r) for r in graph.cooccurrence(rows, ["o"], "s").collect()}
    dealt = graph.cooccurrence(rows, ["o"], "s", tasks=7)
    assert {tuple(r) for r in dealt.collect()} == plain
    with redirect_stdout(io.StringIO()) as told:
        graph.top_partners(dealt, []).explain()
    assert told.getvalue().count("REPARTITION_BY_NUM") == 1


def test_words_are_compared_down_to_the_threshold_only(spark):
    from difflib import SequenceMatcher

    from reelframe.functions.text import short_ratio_at_least

    words = ["USER", "USERS", "SURE", "ASSISTANT", "ASSIST", "TIONBLE"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    ratio = {(a, b): SequenceMatcher(None, a, b).ratio() for a in words for b in words}
    got = {(r["a"], r["b"]): r["r"] for r in rows.withColumn("r", short_ratio_at_least("a", "b", 0.58)).collect()}
    assert got == {k: r if r >= 0.58 else None for k, r in ratio.items()} and None in got.values()


def test_scripts_share_state_and_timers_and_keep_their_ids(spark, tmp_path):
    import datetime as dt

    from reelframe.streaming import stateful

    at = lambda m: dt.datetime(2024, 5, 1) + dt.timedelta(minutes=m)
    ids = [None, 2**53 + 1, 2**53, *range(60)]
    schema = "script_id long, stage string, status string, detail string, at timestamp"
    rows = [(s, "parse", "running" if (i + k) % 3 else "complete", str(k), at(40 * k + i % 7)) for i, s in enumerate(ids) for k in range(4)]
    every = [*rows, (7, "parse", "complete", "", at(1000))]
    for i, part in enumerate([rows[::2], rows[1::2], every[-1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told = stateful.stall_alerts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1800, "200 minutes")
        q = stateful.start(told, f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True)
        q.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(told.schema).parquet(f"{tmp_path}/out").collect()]
    want = [tuple(r) for r in stateful.stalls(spark.createDataFrame(every, schema), at(800), 1800).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {None, 2**53 + 1, 2**53} < {r[0] for r in want}
    # only the clock waits; what is told or complete leaves no state
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_chunks_need_no_call_each_and_stay_whole_across_batches(spark):
    import io
    from contextlib import redirect_stdout

    from reelframe.operators import models

    class Joined:
        def chat_json(self, system, user, schema):
            return {"findings": [{"issue": user.replace("\n\n", "")}]}

    rows = spark.createDataFrame([(s, n // 5, n, chr(97 + n)) for s in (None, 1, 2**53 + 1) for n in range(19, -1, -1)], "script_id long, chunk long, n long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = models.run_pass(rows, models.PASSES["dialogue"], lambda fast: Joined(), ["script_id", "n"], wait=0.0)
        got = {(r["script_id"], r["item_index"], r["answer"]["issue"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(s, i, "abcdefghijklmnopqrst"[5 * i : 5 * i + 5]) for s in (None, 1, 2**53 + 1) for i in range(4)}
    with redirect_stdout(io.StringIO()) as told:
        out.explain()
    assert "MapInArrow" in told.getvalue() and "FlatMapGroupsInPandas" not in told.getvalue()


def test_formatting_checks_parse_scripts_once(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    rows = [(c, t, ("system", "user", "assistant")[t % 3], f"words of {c} and {t}") for c in range(25) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert same_as_sql(spark, str(tmp_path), "formatting_checks", ["conversations"])
    with redirect_stdout(io.StringIO()) as told:
        QUERIES["formatting_checks"](spark, str(tmp_path)).explain()
    assert "conversations.parquet" not in told.getvalue()
