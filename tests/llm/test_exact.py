import hashlib
import re

from pairwright.llm import exact_dedup
from pairwright.llm.common import numbered


def test_edge_rows(edge):
    got = exact_dedup.classes(edge).collect()
    assert len(got) == 12
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for r in edge.collect():
        by.setdefault(norm(r.text), []).append(r.doc_id)
    digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = digests[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(by)


def test_dropping_keeps_columns_and_one_row_of_each_text(edge):
    out = exact_dedup.deduplicated(edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7, 9]
    assert out.where("doc_id is null").count() == 1


def test_empty(empty):
    assert exact_dedup.classes(empty).count() == 0


def test_several_batches_give_one_state(spark, make):
    docs = make([(i, f"t{i % 5}", "en", "a") for i in range(50)]).repartition(6)
    got = exact_dedup.classes(docs, files_per_batch=1).collect()
    assert all(r.group_size == 10 and r.keep_id == r.doc_id % 5 for r in got) and sum(r.kept for r in got) == 5


def test_collided_digests_are_told_apart(spark, make):
    """Rows that share a digest but not their bytes are grouped anew by their texts."""
    docs = make([(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a", "en", "s")])
    at = numbered(docs, "doc_id", "text", name="loc")
    who = "struct(false as absent, doc_id, loc) as _who"
    base = at.selectExpr("doc_id", "struct(false as absent, cast(1 as bigint) as doc_id, cast(0 as bigint) as loc) as keeper", "cast(3 as bigint) as group_size", "'same' as text_sha256", who)
    out = exact_dedup.split_collisions(base, at.selectExpr("loc", "text as body", "'same' as digest")).collect()
    assert {(r.doc_id, r.keeper.doc_id, r.group_size) for r in out} == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}
