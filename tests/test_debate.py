"""Claims, probes, relationships and lanes on rows of our own."""

from __future__ import annotations

from evidentia.functions.dialect import SPARK, Pipe
from evidentia.operators import debate as B
from evidentia.operators import ranking as K
from evidentia.plans import registry, sql_queries

SF = "/root/testdata/sf0.001"


def rows(spark, build, data, schema):
    spark.createDataFrame(data, schema).createOrReplaceTempView("src")
    p = Pipe(SPARK)
    return [r.asDict() for r in spark.sql(p.sql(build(p))).collect()]


def test_structured_claim(spark):
    def build(p):
        B.structured_claim(p, "c", "src")
        return "select * from c"

    got = {r["id"]: r for r in rows(spark, build, [(1, "Oversight prevents Leaders from striking rivals."), (2, "Just a view"), (3, "Aid leads to growth")], "id int, text string")}
    assert (got[1]["relation"], got[1]["subject"], got[1]["target_actor"], got[1]["target_action"], got[1]["target_object"]) == ("PREVENTS", "Oversight", "Leaders", "strike", "rivals")
    assert got[1]["has_structure"] and abs(got[1]["claim_confidence"] - 0.98) < 1e-9 and got[1]["display_effect"] == "Leaders striking rivals"
    assert got[2]["relation"] == "UNKNOWN" and got[2]["claim_confidence"] == 0.2 and got[3]["relation"] == "CAUSES"


def test_intent(spark):
    def build(p):
        K.intent(p, "i", "src")
        return "select * from i"

    data = [(1, "author:Tucker year:2019-2021 count:99 arms control"), (2, "Tucker 20"), (3, "AT: Topicality"), (4, "they argue trade causes peace."), (5, "Tucker"), (6, "Smith ’98"), (7, "free trade")]
    got = {r["id"]: r for r in rows(spark, build, data, "id int, text string")}
    assert [got[i]["search_mode"] for i in range(1, 8)] == ["citation", "citation", "section", "argument", "author", "citation", "general"]
    assert (got[1]["year_min"], got[1]["year_max"], got[1]["requested_count"], got[1]["search_text"]) == (2019, 2021, 50, "arms control")
    assert got[2]["year_min"] == 2020 and got[6]["year_min"] == 1998 and got[4]["opponent_claim"] == "trade causes peace"


def test_command(spark):
    def build(p):
        B.debate_query(p, "c", "src")
        return "select * from c"

    got = {r["id"]: r for r in rows(spark, build, [(1, "turn> growth"), (2, "Opponents contend growth is bad."), (3, "nope> x"), (4, "compare> y")], "id int, text string")}
    assert [(got[i]["debate_intent"], got[i]["perspective"]) for i in range(1, 5)] == [("turn", "opponent"), ("answer", "opponent"), ("search", "neutral"), ("compare", "both")]
    assert got[2]["semantic_query"] == "growth is bad"


def test_probes(spark):
    def build(p):
        B.probes(p, "pr", "src")
        return "select * from pr order by query_id, ord"

    got = rows(spark, build, [(1, "Congress prevents Leaders from striking rivals", "answer"), (2, "Views differ", "search"), (3, "Growth hurts forests", "turn")], "query_id int, text string, debate_intent string")
    one = {r["kind"]: r["probe"] for r in got if r["query_id"] == 1}
    assert one["circumvention"] == "Leaders can strike rivals despite Congressional" and one["no_link"].endswith("Leaders' ability to strike rivals")
    assert [r["kind"] for r in got if r["query_id"] == 2] == ["original"]
    assert {r["probe"] for r in got if r["kind"] == "turn" and r["query_id"] == 3} == {"Growth protects or strengthens forests"}


def test_golden_relationships(spark):
    got = {r.query_id: r.claim_relationship for r in registry.run(spark, SF, "claim_relationships_golden").collect()}
    want = {1: "SUPPORTS", 3: "NON_UNIQUE", 4: "INDICTS", 5: "TURNS", 7: "IRRELEVANT", 9: "UNKNOWN"}
    assert {k: got[k] for k in want} == want and got[11] in ("CONTRADICTS", "MITIGATES", "SUPPORTS") and len(sql_queries.GOLDEN) == len(got)
