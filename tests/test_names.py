"""Names free of collisions against giving them out one after another."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.operators.names import claim_of, free_names, standing, stops


@given(st.lists(st.integers(-3, 40), max_size=40), st.integers(0, 40))
def test_stops_tell_how_many_claims_stand(limits, before):
    held = stops(limits)
    assert held == sorted(set(held))
    assert sum(s >= 0 for s in standing(limits, before)) == sum(s >= before for s in held)


def numbered(name: str, number: int) -> str:
    found = re.search(r"(?s)(?<=.)\.[^.]+\Z", name)
    at = found.start() if found else len(name)
    return f"{name[:at]} ({number}){name[at:]}" if number else name


def in_turn(wants: list[tuple[str, str]], existing: set[str]) -> list[str]:
    taken, out = set(existing), []
    for folder, name in wants:
        number = 0
        while f"{folder}/{numbered(name, number)}" in taken:
            number += 1
        out.append(f"{folder}/{numbered(name, number)}")
        taken.add(out[-1])
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_names_equal_those_given_in_turn(spark, seed):
    rng = random.Random(seed)

    def name() -> str:
        numbers = "".join(f" ({rng.choice(['1', '2', '3', '5', '01', '0', str(rng.randint(1, 30))])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])))
        return rng.choice(["a", "b", "a b", ".c", "d (1)x"]) + numbers + rng.choice([".txt", ".txt", "", ".e (1)", ".", "(2).t"])

    wants = [(rng.choice(["/t/x", "/t/y"]), name()) for _ in range(400)]
    existing = {f"{rng.choice(['/t/x', '/t/y', '/t/z'])}/{name()}" for _ in range(seed * 20)}
    rows = spark.createDataFrame([(i, folder, own) for i, (folder, own) in enumerate(wants)], "i long, folder string, name string")
    there = spark.createDataFrame([(p,) for p in existing], "full_path string") if existing else None
    got = free_names(rows, "folder", "name", [F.col("i")], there, chunk=3).orderBy("i").collect()
    assert [r.destination_path for r in got] == in_turn(wants, existing)
    assert [r.seq for r in got] == list(range(1, 401))


def test_a_hot_name_and_a_long_run_of_claims(spark):
    rng = random.Random(7)
    wants = [("/t", "x.txt") for _ in range(1500)] + [("/t", f"x ({k}).txt") for k in range(1, 1200)]
    rng.shuffle(wants)
    rows = spark.createDataFrame([(i, *w) for i, w in enumerate(wants)], "i long, folder string, name string")
    got = free_names(rows, "folder", "name", [F.col("i")], None, chunk=100).orderBy("i").collect()
    assert [r.destination_path for r in got] == in_turn(wants, set())


def test_claims(spark):
    names = {"a (1).txt": ("a.txt", 1), "a (2)": ("a", 2), "a (1) (2).t": ("a (1).t", 2), " (1)": ("", 1), "a (0).t": None, "a (01)": None, "b.c (1)": None, "a (9999999999999999999).t": None, "a (1)\n": None}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", *(c.alias(n) for c, n in zip(claim_of(F.col("name")), ("base", "number"), strict=True)))
    assert {r.name: (r.base, r.number) if r.base is not None else None for r in rows.collect()} == names
