"""Operators do the whole job: no node is left out."""

from parlance.operators import hierarchy


def test_descendants_of_every_node(spark):
    # a chain with a branch; a circle c1 > c2 > c3 > c1 with a tail; a circle of one node with a tail
    up = {"b": "a", "c": "b", "d": "c", "e": "b", "c1": "c2", "c2": "c3", "c3": "c1", "t1": "c2", "t2": "t1", "s": "s", "u": "s"}
    want = set()
    for node in up:
        seen, spot, steps = {node}, up.get(node), 1
        while spot and spot not in seen:
            want.add((spot, node, steps))
            seen.add(spot)
            spot, steps = up.get(spot), steps + 1
    rows = spark.createDataFrame([(k, up.get(k)) for k in [*up, "a"]], "id string, parent string")
    links = hierarchy.links(rows, "id", "parent")
    h = hierarchy.decompose(links)
    around = hierarchy.decompose(hierarchy.opened(links, h.circles)).labels
    got = [tuple(r) for r in hierarchy.all_descendants(h.labels, around, h.circles).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("b", "c", 1) in want and ("t1", "t2", 1) in want and ("c1", "t2", 4) in want
