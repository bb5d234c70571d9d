"""Every registered query with SQL against DuckDB, on the smallest tables."""
import duckdb
import pytest

from reelframe.plans.oracles import oracles
from reelframe.plans.queries import QUERIES, oracle_free

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle_or_is_named():
    assert set(QUERIES) == set(oracles()) | oracle_free()


@pytest.mark.parametrize("name", sorted(oracles()))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(oracles()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert [str(got.schema.field(c).type) for c in columns] == [str(want.schema.field(c).type) for c in columns]
    rows = lambda t: sorted(map(str, zip(*[t[c].to_pylist() for c in columns])))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(oracle_free() - {"quote_verify_fuzzy"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rule_lookup_whole_leaves_no_row_out(spark, duck):
    rows = QUERIES["rule_lookup_whole"](spark, SF).collect()
    assert len(rows) == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    of = {c: duck.sql(f"SELECT count(*) FROM part WHERE p_type IN ({x})").fetchall()[0][0] for c, x in (("building", "'ECONOMY'"), ("machinery", "'SMALL'"), ("furniture", "'LARGE', 'PROMO'"))}
    assert any(of.values()) and all(r["rules"] == of.get(r["category"], 0) for r in rows)


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    """Turns that begin alike and differ after 80 characters, or differ first and are alike after it; a name at the end."""
    home, opening = str(tmp_path_factory.mktemp("turns")), "the very same opening words stand at the head of each of these turns here and now "
    tails = ["zq xj " * 60, "kk vv ww " * 40, "mm nn " * 60 + "the assistant", "pp bb " * 60, "gg hh " * 60]
    rows = [(c, t, ("user", "assistant")[t % 2], opening + tails[(c + t) % 5]) for c in range(3) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{home}/conversations.parquet")
    return home, rows


def test_carried_findings_compare_whole_turns(spark, long_turns):
    from difflib import SequenceMatcher

    home, rows = long_turns
    want = {(c, t): max(SequenceMatcher(None, text.lower(), old.lower()).ratio() for d, u, _, old in rows if d == c and u % 2 == 0) >= 0.5 for c, t, _, text in rows if t % 2 == 1}
    heads = {(c, t): max(SequenceMatcher(None, text[:80], old[:80]).ratio() for d, u, _, old in rows if d == c and u % 2 == 0) >= 0.5 for c, t, _, text in rows if t % 2 == 1}
    got = {(r["conv_id"], r["turn"]): r["carried"] for r in QUERIES["carried_findings"](spark, home).collect()}
    assert got == want != heads


def test_character_references_see_the_end_of_a_turn(spark, long_turns):
    home, rows = long_turns
    got = {r["text_id"] for r in QUERIES["character_references"](spark, home).where("name = 'ASSISTANT' and tier = 1").collect()}
    assert {c * 100 + t for c, t, _, text in rows if text.endswith("the assistant")} <= got


def test_fuzzy_quotes_are_whole_turns(spark, long_turns):
    import re
    from difflib import SequenceMatcher

    home, rows = long_turns
    plain = lambda t: re.sub(r"\s+", " ", t.lower()).strip()

    def best(quote, body):
        wanted, found = quote.split(), body.split()
        size = max(len(wanted), 3)
        starts = range(0, max(1, len(found) - size + 1), max(1, size // 2))
        return max(SequenceMatcher(None, quote, " ".join(found[at : at + size + 2])).ratio() for at in starts)

    bodies = {c: plain(" ".join(text for d, _, _, text in rows if d == c)) for c in range(3)}
    want = {(c + 1, t): best("changed " + plain(text), bodies[c]) >= 0.72 for c, t, _, text in rows}
    heads = {(c + 1, t): best("changed " + " ".join(plain(text).split()[:8]), bodies[c]) >= 0.72 for c, t, _, text in rows}
    got = {(r["scene_number"], r["element_index"]): r["verified"] for r in QUERIES["quote_verify_fuzzy"](spark, home).collect()}
    assert got == want != heads
