"""Text operators on hand-worked rows."""

from __future__ import annotations

import pytest

from evidentia.functions import stem
from evidentia.functions import text as T
from evidentia.functions.dialect import DUCK, SPARK, Pipe


def run(spark, build, rows, schema):
    """Rows of a Pipe's relation in both engines."""
    import duckdb

    out = []
    spark.createDataFrame(rows, schema).createOrReplaceTempView("src")
    for d in (SPARK, DUCK):
        p = Pipe(d)
        sql = p.sql(build(p))
        if d is SPARK:
            out.append([r.asDict() for r in spark.sql(sql).collect()])
        else:
            import pandas as pd

            con = duckdb.connect()
            con.register("src", pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]))
            r = con.execute(sql)
            names = [c[0] for c in r.description]
            out.append([dict(zip(names, x)) for x in r.fetchall()])
    return out


def test_terms_and_phrases(spark):
    def build(p):
        T.add_phrases(p, "x", "src", t="text")
        return f"select id, {p.d.join(p.d.sort(T.terms(p.d, 'text')), ' ')} as terms, {p.d.join(p.d.sort('t_phrases'), ' ')} as phrases from x"

    rows = [(1, "The United-States uses nuclear weapons"), (2, "it is"), (3, "")]
    for found in run(spark, build, rows, "id int, text string"):
        got = {r["id"]: r for r in found}
        assert got[1]["terms"] == "nuclear united-states weapons"
        assert set(got[1]["phrases"].split()) == {"united_stat_nuclear", "nuclear_weapon", "united_stat_nuclear_weapon", "united_states_nuclear", "nuclear_weapons", "united_states_nuclear_weapons"}
        assert got[2]["terms"] == "" and got[3]["phrases"] == ""


@pytest.mark.parametrize(("word", "want"), [("cats", "cats"), ("weapons", "weapon"), ("organization", "organ"), ("escalation", "escalat"), ("was", "was"), ("payments", "payment"), ("investments", "invest"), ("studies", "stud"), ("racing", "racing"), ("striking", "strik"), ("ring", "ring"), ("ratio-nal", "ratio_nal")])
def test_canonical(spark, word, want):
    assert T.canonical_py(word) == want
    for d in (SPARK,):
        assert spark.sql(f"select {T.canonical(d, 'w')} as c from (select '{word}' as w)").first().c == want


def test_mechanism(spark):
    def build(p):
        T.add_mechanism(p, "m", "src", "q", "text")
        cols = ", ".join(f"{p.d.join(p.d.sort(f'q_{k}'), ' ')} as {k}" for k in ("actor", "cause", "effect"))
        return f"select id, {cols}, q_polarity as polarity from m"

    rows = [(1, "Strong alliances prevent wars"), (2, "Markets fall because of tariffs"), (3, "Plain statement"), (4, "Tariffs increase prices and reduce trade")]
    for found in run(spark, build, rows, "id int, text string"):
        got = {r["id"]: r for r in found}
        assert got[1] == {"id": 1, "actor": "allianc alliances strong", "cause": "allianc alliances strong", "effect": "wars", "polarity": -1}
        assert (got[2]["actor"], got[2]["cause"], got[2]["effect"], got[2]["polarity"]) == ("market markets", "tariff tariffs", "fall", 1)
        assert (got[3]["cause"], got[3]["polarity"]) == ("", 0) and got[4]["polarity"] == -1


def test_porter():
    for w, s in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll"}.items():
        assert stem.stem(w) == s, w
