"""Cases that the operators once left out."""

import numpy as np
import pytest

from fleetlens.llm import licenses, main_text, pitman_yor


# ---- 9: language model -------------------------------------------------------------------

def test_every_level_is_burnt_in_and_predictions_are_averaged():
    assert all(burn_in >= 1 and samples >= 1 for burn_in, samples in pitman_yor.SWEEPS)
    assert pitman_yor.SWEEPS[-1][0] >= 2 and pitman_yor.SWEEPS[-1][1] >= 3


def test_dishes_of_one_customer_are_seated_in_closed_form():
    """A restaurant of dishes with 1, 1, 2 and 0 customers, against enumeration."""
    d, strength, base = 0.4, 1.0, 0.1
    n = 4000
    tables, opened = pitman_yor.seat(np.repeat(np.arange(n), 4), np.tile([1, 1, 2, 0], n), np.full(4 * n, base),
                                     d, strength, 1, 2, 4)
    tables = tables.reshape(n, 4)
    # two customers at one table or at two, the other dishes' two tables being there
    apart = (strength + 3 * d) * base
    together = 1 - d
    assert (tables[:, :2] == 1).all() and (tables[:, 3] == 0).all()
    assert abs(tables[:, 2].mean() - (2 * apart + together) / (apart + together)) < 0.02
    assert np.allclose(tables.sum(1), opened)


def test_contexts_outside_the_class_vocabulary_are_learnt(spark):
    """Rare words of equal ending follow each other in fixed triples: one class, many contexts."""
    rng = np.random.default_rng(5)
    n = 3000                        # more words than there are classes of their own
    chains = [[f"w{i}q{j}zzz" for j in range(4)] for i in range(n)]
    rows = [(i, " ".join(w for k in rng.permutation(n)[:300] for w in chains[k])) for i in range(150)]
    rows += [(10_000 + i, " ".join(chains[i])) for i in range(400)]
    shuffled = [(20_000 + i, " ".join(chains[i][:2] + chains[i + 1][2:])) for i in range(400)]
    docs = spark.createDataFrame(rows + shuffled, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(docs).collect() if r["held_out"]}
    known = np.mean([r["score"] for i, r in got.items() if 10_000 <= i < 20_000])
    broken = np.mean([r["score"] for i, r in got.items() if i >= 20_000])
    assert known > broken + 1.0


def test_word_contexts_give_probabilities(spark):
    """Scores stay finite and repeated text is nearly certain, with hot contexts split."""
    docs = spark.createDataFrame([(i, "a b " + "c d " * 3000 + f"a b x{i % 7}") for i in range(40)], "doc_id long, text string")
    rows = pitman_yor.score_documents(docs).collect()
    assert len(rows) == 40 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    # in "c d c d ..." nearly every token is certain
    assert min(r["score"] / r["n_tokens"] for r in rows) > -0.1


# ---- 10: main text -----------------------------------------------------------------------

BODY = "<p>One, two, three, and some more words to make it long.</p><p>Short.</p>"
LINKS = '<ul><li><a href="/1">First source</a></li><li><a href="/2">Second one</a></li><li><a href="/3">Third</a></li></ul>'


@pytest.mark.parametrize("page", [
    f'<a href="#c">Skip to content</a><div class="content has-sidebar"><article>{BODY}</article></div>',
    f'<a href="#c">Skip to content</a><div id="no-sidebar">{BODY}</div>',
    f'<div class="side-by-side"><main>{BODY}</main><div class="sidebar"><p>Other, other, other things to look at.</p></div></div>',
    f'<article><div class="entry no-sidebar">{BODY}</div><div class="ad">Buy, buy, buy now and here, all</div></article>',
])
def test_names_do_not_drop_what_wraps_the_article(page):
    text = main_text.main_text(page)
    assert "One, two, three, and some more words to make it long. Short." in text
    assert "Buy" not in text and "Other" not in text


def test_lists_of_sources_stay_in_the_article():
    want = "One, two, three, and some more words to make it long. Short. First source Second one Third"
    assert main_text.main_text(f"<article>{BODY}{LINKS}</article>") == want
    assert main_text.main_text(f'<article>{BODY}<div class="related">{LINKS}</div></article>') == want[:want.index(" First")]


def test_comments_longer_than_the_text_stay_out():
    comments = '<div class="comments"><p>I like this, very much, thank you, really, a lot, and more.</p></div>' * 9
    assert "like" not in main_text.main_text(f"<div>{BODY}</div>{comments}")


# ---- 6: licences -------------------------------------------------------------------------

@pytest.mark.parametrize("line, want", [
    ("Licensed under the MIT License.", "MIT"), ("Licensed under the Apache License 2.0.", "Apache-2.0"),
    ("Distributed under the MIT License.", "MIT"), ("Released under our MIT License.", "MIT"),
    ("Released under the Foo License.", None), ("This file is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("We went under the bridge and read the news.", None),
])
def test_usual_variants_and_one_changed_word(line, want):
    found = licenses.Scanner(licenses.TEMPLATES).matches(f"Some words. {line} Other words.")
    assert [m[0].split()[0] for m in found] == ([want] if want else [])


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"])
def test_full_texts(name):
    text = licenses.TEMPLATES[f"{name} notice text"]
    found = licenses.Scanner(licenses.TEMPLATES).matches(f"Copyright 2020 Some One {text} And more.")
    assert [m[0] for m in found] == [f"{name} notice text"]


def test_rights_notices_and_mentions(spark):
    docs = spark.createDataFrame([(1, "Text. All rights reserved. End."), (2, "I like the MIT License most."),
                                  (3, "Text. Licensed under the MIT License.")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert rows[1]["license"] is None and [m["name"] for m in rows[1]["matches"]] == ["All-rights-reserved notice"]
    assert rows[2]["n_matches"] == 0 and rows[3]["license"] == "MIT"
