from __future__ import annotations

import pytest

from sourcemark.llm import decontaminate as D

from .conftest import MESS


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, share int")


QUESTION = "A train leaves Paris at 40 km an hour and Alice waits 3 hours; how far does the train go in 3 hours at 40 km an hour?"


def test_whole_passages_are_found(spark, small, documents):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    docs, there = [(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()]
    want = {(d, i) for d, t in docs for i, x in there if x in t}
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents, bench).collect()}
    assert want
    assert want <= got
    kept = D.without_leaks(documents, bench)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_slots(spark, docs_of):
    docs = [(1, "so " + QUESTION + " right"), (2, QUESTION.replace("40", "55").replace("3", "7").replace("Paris", "Rome").replace("Alice", "Bob")), (3, QUESTION.replace("3 hours; how", "4 hours; how").replace("40 km an hour?", "60 km an hour?")), (4, QUESTION.upper().replace(" ", "*** ")), (5, "A train leaves the yard and nobody waits for it to go anywhere at all today")]
    got = {r.doc_id: r for r in D.leaks(docs_of(docs), items(spark, [(7, QUESTION)])).collect()}
    assert got[1].exact
    assert got[2].item_id == 7
    assert not got[2].exact
    assert got[3].share < got[2].share  # windows whose values disagree don't count
    assert 5 not in got


COPIES = ["Who wrote Pride and Prejudice?", "Capital of France?", "Solve 3x = 12", "Name The First King Of The United Kingdom Of Great Britain And Ireland", "12 13 14 15 16 17 18 19 20 21 22", "Paris was built by people of many trades"]


@pytest.mark.parametrize("around", ["{}", "And now {} to say a few more words about it all."])
def test_copies_of_few_literals_are_found(spark, docs_of, around):
    docs = [(i, around.format(x)) for i, x in enumerate(COPIES)]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(docs_of([*docs, (99, "Nothing of this kind stands here, 4x = 13")]), items(spark, list(enumerate(COPIES)))).collect()}
    assert got.keys() == {(i, i) for i in range(len(COPIES))}
    assert all(r.exact and r.share == 1 for r in got.values())


def test_a_sibling_before_a_copy_does_not_bind_its_values(spark, docs_of):
    item = "Tom has 5 apples and buys 3 more apples today. How many now?"
    other = item.replace("5", "7").replace("3", "2").replace("Tom", "Ann")
    sibling = "Tom has 9 apples and buys 4 more pears. "
    docs = [(1, sibling + item), (2, sibling + other), (3, item + " " + sibling), (4, sibling * 40 + other + " " + sibling)]
    got = {r.doc_id: r for r in D.leaks(docs_of(docs), items(spark, [(7, item)])).collect()}
    assert got.keys() == {1, 2, 3, 4}
    assert all(got[i].exact and got[i].share == 1 for i in (1, 3))
    assert all(got[i].share >= 0.8 and not got[i].exact for i in (2, 4))


@pytest.mark.parametrize("limit", [8_000_000, 60])
def test_edges_and_blocks(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(D, "BLOCK_CHARS", limit)
    monkeypatch.setattr(D.blocks, "__defaults__", (limit,))
    docs = [*MESS, (30, QUESTION), (31, "short one here")]
    bench = items(spark, [(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (None, "short one here"), (4, "...")])
    got = [(r.doc_id, r.item_id) for r in D.leaks(docs_of(docs), bench).collect()]
    assert sorted(got, key=str) == [(30, 1), (30, 1), (31, None)]
    assert D.without_leaks(docs_of(docs), bench).count() == len(docs) - 2
    assert D.leaks(docs_of([]), bench).count() == 0
    assert D.leaks(docs_of(docs), items(spark, [])).count() == 0
