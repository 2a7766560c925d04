"""The hierarchical report: its tree against plain counting, and reading back what was written."""

from collections import Counter

import pytest

from plumeria.sources import reports


@pytest.fixture
def lookup(spark):
    rows = []
    for k in range(60):
        code = ["0a", "0b", "1", "10aa", "10ab", None][k % 6]
        rows.append((f"lookup_{k:06d}", code, ["For", "Against", None, "For"][k % 4], f"Text {k} about rivers\n and water  protection. " * (1 + k % 9), k % 7, f'he said "x: {k}"' if k % 2 else None, f"score: {k}"))
    return spark.createDataFrame(rows, "lookup_id string, cluster_id string, stance string, truncated_text string, comment_count int, key_quote string, rationale string")


@pytest.fixture
def members(spark):
    return spark.createDataFrame([(f"C-{k}-{i}", f"lookup_{k:06d}") for k in range(60) for i in range(k % 7)], "id string, lookup_id string")


def test_tree_counts_each_row_in_all_its_clusters(lookup, members):
    nodes = {r.cluster_id: r for r in reports.tree(lookup, members).collect()}
    assert sorted(nodes) == ["0", "0a", "0b", "1", "10", "10a", "10aa", "10ab"]
    rows = [r for r in lookup.collect() if r.cluster_id]
    for code, node in nodes.items():
        number = code.rstrip("ab")
        own = [r for r in rows if r.cluster_id.startswith(code) and r.cluster_id.rstrip("ab") == number]
        n = Counter()
        for r in own:
            n[r.stance or "Unknown"] += r.comment_count
        assert node.unique_texts == len(own) and node.total_comments == sum(n.values()) and node.level == len(code) - len(number)
        assert dict(map(tuple, node.stances)) == dict(n) and n[node.dominant] == max(n.values())
        agree = sorted(r.lookup_id for r in own if (r.stance or "Unknown") == node.dominant)
        other = sorted(r.lookup_id for r in own if (r.stance or "Unknown") != node.dominant)
        assert [e.lookup_id for e in node.examples] == agree[:3] and [e.lookup_id for e in node.deviations] == other[:5] and node.more_deviations == max(0, len(other) - 5)
        for e in node.examples:
            k = int(e.lookup_id[7:])
            assert e.comment_ids == [f"C-{k}-{i}" for i in range(k % 7)][:3] and e.more_ids == max(0, k % 7 - 3)
    assert {"rivers", "water", "protection"} <= set(nodes["1"].keywords)


def test_what_is_written_is_read_back(spark, lookup, members, tmp_path):
    nodes = reports.tree(lookup, members)
    (tmp_path / "r.txt").write_text(reports.text(nodes))
    key = lambda r: r.cluster_id
    assert sorted(reports.read(spark, str(tmp_path / "r.txt")).collect(), key=key) == sorted(nodes.collect(), key=key)
    lines = reports.text(nodes).split("\n")
    assert lines.index("CLUSTER 0") < lines.index("  CLUSTER 0a") < lines.index("CLUSTER 1") < lines.index("CLUSTER 10") < lines.index("    CLUSTER 10aa")


def test_without_members_and_empty(spark, lookup, tmp_path):
    assert all(e.comment_ids == [] for r in reports.tree(lookup).collect() for e in r.examples)
    (tmp_path / "r.txt").write_text(reports.text(reports.tree(lookup.limit(0))))
    assert reports.read(spark, str(tmp_path / "r.txt")).count() == 0
