"""The manifest against trees built whole, level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelgauge.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 16 : at - at % 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def fold(node, way):
    for before, after in way:
        node = sha("".join([*before, node, *after]))
    return node


def built(spark, rows):
    schema = "id long, src string, leaf string, other string, held string, node string, gid int"
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)


@pytest.mark.parametrize("sizes", [{"a": 257, "b": 16, None: 17, "": 1, "ü": 256}, {None: 1}, {"one": 700}, {f"s{i}": 2 for i in range(40)}])
def test_against_whole_trees(spark, sizes):
    groups, rows = {}, []
    for src, n in sizes.items():
        ids = [None, None, *range(5, 3 + n)][-n:] if n > 2 else list(range(n))
        leaves = [(i, sha(f"{src}:{i}:{'same' if i is None else ''}")) for i in ids]
        groups[src] = sorted(leaves, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        rows += [(i, src, leaf, sha("other" + leaf) if (i or 0) % 5 == 1 else None) for i, leaf in leaves]
    docs = built(spark, rows).repartition(5)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: whole_tree([leaf for _, leaf in groups[s]]) for s in names}
    over = whole_tree([trees[s][-1][0] for s in names])
    want = []
    for s in names:
        for at, (i, leaf) in enumerate(groups[s]):
            way = path(trees[s], at) + path(over, names.index(s))
            end = fold(sha("other" + leaf) if (i or 0) % 5 == 1 else leaf, way)
            proof = sha("".join("".join([*b, *a]) for b, a in way))
            want.append((str(i), str(s), leaf, trees[s][-1][0], over[-1][0], proof, end, end == over[-1][0]))
    made = merkle.Manifest(docs, "src", "id", "leaf", "other", keep=["id", "src", "held", "node", "gid"])
    proofs = made.proofs()
    assert proofs.columns[:5] == ["id", "src", "held", "node", "gid"]
    got = [(str(r.id), str(r.src), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in proofs.collect()]
    # rows alike in group, order and leaf may stand in either place
    once = lambda rows: sorted(r for r in rows if r[0] != "None")
    assert once(got) == once(want) and sorted(r[:5] for r in got) == sorted(r[:5] for r in want)
    assert sorted(r[5:] for r in got) == sorted(r[5:] for r in want)
    assert {(r.group, r.subroot) for r in made.subroots().collect()} == {(s, trees[s][-1][0]) for s in names}


def test_empty_table(spark):
    made = merkle.Manifest(built(spark, []), "src", "id", "leaf", "other", keep=["id"])
    assert made.root is None and made.proofs().count() == 0 and made.subroots().count() == 0


def test_fields_tell_null_from_text(spark):
    row = spark.range(1).select(
        merkle.leaf_hash(F.lit(7), F.lit(None).cast("string"), F.lit("-"), F.lit(""), F.lit("ü")).alias("h")
    )
    assert row.first().h == sha("1:7-1:-0:2:ü")


def test_levels_between_are_not_stored(spark):
    rows = [(i, "s", sha(str(i)), None) for i in range(300)]
    made = merkle.Manifest(built(spark, rows), "src", "id", "leaf", keep=["id"])
    assert [t.count() for t in made.tables] == [300, 2, 1]
