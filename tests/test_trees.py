import json
import random

from tidewheel.operators import trees as W


def walk(node, path=()):
    yield path, node.get("name") if isinstance(node, dict) else None
    below = node.get("children") if isinstance(node, dict) else None
    for i, child in enumerate(below if isinstance(below, list) else []):
        yield from walk(child, (*path, i))


def test_any_depth_in_preorder(spark):
    rng = random.Random(2)

    def grow(depth):
        node = {"node_type": "t", "name": f"n{rng.randrange(100)}"}
        if depth:
            node = {"children": [grow(depth - 1 if k == 0 else rng.randrange(min(depth, 3))) for k in range(rng.randrange(1, 4))]} | node
        return node

    trees = [grow(d) for d in (0, 1, 5, 12, 12)] + [{"name": "x", "children": [7, "s", None, {"name": "y", "children": {"name": "no"}}]}]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(90, "[1]"), (91, "bad"), (92, None)]
    df = spark.createDataFrame(rows, "id long, tree string").repartition(3)
    found = W.flatten(df, "id", "tree")
    want = [(i, list(path), len(path), name) for i, t in enumerate(trees) for path, name in walk(t)]
    assert sorted(tuple(r)[:4] for r in found.select("id", "path", "depth", "name").collect()) == sorted(want)
    assert max(w[2] for w in want) == 12
    for r in W.listed(found, "id").collect():
        assert [(n.depth, n.name) for n in r.tree] == [(len(p), n) for p, n in walk(trees[r.id])]


def test_no_trees(spark):
    assert W.flatten(spark.createDataFrame([], "id long, tree string"), "id", "tree").collect() == []
