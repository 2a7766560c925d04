"""Bounds of the pattern grammar, the URL rules and the extraction, against plain searches."""

import itertools
import time
from collections import Counter

import numpy as np
import pytest

from plumeria.llm import html_extract, toxicity, url_rules


def clauses(grammar, text):
    """Each clause on its own: text between end marks, scored from the machine's start."""
    out, start = [], 0
    for end in [*(i for i, c in enumerate(text) if c in ".!?;:\n"), len(text)]:
        out += [(start + a, start + b, s) for a, b, s in grammar.clauses(text[start:end])]
        start = end + 1
    return out


def test_clauses_are_scored_alone_and_in_linear_time():
    grammar = toxicity.Grammar({("idiot", False): ("insult", 2.0), ("stup", True): ("insult", 1.5)})
    rng = np.random.default_rng(1)
    words = ["you", "idiot", "are", "not", "stupid", "said", "fine", ".", "!", "\n", ";", "a:b", "idiots"]
    for _ in range(300):
        text = " ".join(words[k] for k in rng.integers(0, len(words), 30))
        assert grammar.clauses(text) == clauses(grammar, text)
    took = []
    for n in (20_000, 160_000):
        text = "you idiot. " * n  # marks besides the full stop never come
        at = time.perf_counter()
        assert len(grammar.clauses(text)) == n
        took.append(time.perf_counter() - at)
    assert took[1] < 24 * took[0] + 1  # eight times as long; 64 times if it were quadratic


@pytest.mark.parametrize(("page", "text"), [
    ("<html><body><p>Short text.</p></body></html>", "Short text."),
    ("<p>Home</p>", "Home"),
    ("<article><p>This is the article's text, which is long enough.</p></article><p>Home <a href=http://x.org/a/>more</a></p>", "This is the article's text, which is long enough."),
    ('<div class="nav"/><p>Menu</p></div><p>This is the text of the page.</p>', "This is the text of the page."),
    ("<p>Before <svg><path d='m'/><circle/></svg>and after the picture.</p>", "Before and after the picture."),
    ("<p>Line<br/>break and an image <img src=a.png/> in it.</p>", "Line break and an image in it."),
])
def test_short_texts_and_slashes(page, text):
    assert html_extract.main_text(page) == text


def minimal_rules(rows):
    """All sets of up to three tokens that are frequent and confident, without those that contain another."""
    own = [(frozenset(url_rules.tokens(u)), b) for u, b in rows]
    found = []
    for size in (1, 2, 3):
        n, hits = Counter(), Counter()
        for tokens, blocked in own:
            for some in itertools.combinations(sorted(tokens), size):
                n[some] += 1
                hits[some] += blocked
        found += [frozenset(t) for t in n if hits[t] >= url_rules.MIN_SUPPORT * len(rows) and hits[t] / n[t] >= url_rules.MIN_CONFIDENCE and not any(f < frozenset(t) for f in found)]
    return found


def test_no_minimal_rule_is_missing(spark):
    """Verdicts over fresh URLs are those of all minimal rules."""
    rng = np.random.default_rng(2)
    made = lambda: f"http://{rng.choice(['shop', 'news', 'bet'])}{rng.choice(['', '-free'])}.{rng.choice(['com', 'org'])}/{rng.choice(['a', 'b', 'win'])}/{rng.integers(0, 9)}"
    bad = lambda u: "bet" in u or ("free" in u and "win" in u)
    rows = [(u, bool(bad(u))) for u in {made() for _ in range(600)}]
    index = url_rules.RuleIndex(url_rules.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean")))
    rules = minimal_rules(rows)
    for u in {made() for _ in range(200)}:
        own = set(url_rules.tokens(u))
        assert index.blocked(u) == any(r <= own for r in rules) == bad(u)


def test_deep_shared_paths_do_not_multiply(spark):
    deep = "/".join(f"seg{k}" for k in range(25))
    rows = [(f"http://free-x{k}.cheap.com/{deep}/{k}", True) for k in range(60)] + [(f"http://site{k}.org/{deep if k < 60 else k}", False) for k in range(2000)]
    at = time.perf_counter()
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert time.perf_counter() - at < 60 and url_rules.RuleIndex(rules).blocked("http://free-y.cheap.com/z")
