import hashlib
import random

import numpy as np
import pytest

from corpus_pipeline import benchmark_leaks, near_copies
from papergraph.llm.chat import format_turns, parse, read_back, render
from papergraph.llm.decontaminate import contaminated
from papergraph.llm.html_text import extract_text
from papergraph.llm.langid import fit_languages, identify_languages
from papergraph.llm.mixing import epochs_at, mix_sources, solve_exponent
from papergraph.llm.ngram_join import ngram_components, ngram_links
from papergraph.llm.quality import score_quality
from papergraph.llm.repeats import remove_repeats
from papergraph.llm.sharding import byte_shards
from papergraph.llm.topk import exact_top_k, read_lists

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts], SCHEMA)


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            old = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, 3])):
                old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 120]))))
    return [*enumerate(texts), (100, None), (101, ""), (102, " \n"), (103, "É w1"), (104, "é w1")]


def test_ngram_components_against_all_pairs(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split() if i < 103 else t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    find = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    find[a] = find[b] = min(find[a], find[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs_of(spark, rows)).collect()}
    assert got == {i: (len(s), find[i]) for i, s in sets.items()}


def test_repeats_against_every_window(spark):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh é") for _ in range(260))
    rows = [(i, "".join(rng.choice("xyz \n") for _ in range(rng.choice([0, 90, 300]))) + shared[rng.randrange(99) :] + "q" * rng.choice([0, 130])) for i in range(15)] + [(20, None)]
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            gone[s : s + 100] |= b[s : s + 100] in seen
            seen.add(b[s : s + 100])
        assert got[i].n_removed == gone.sum()
        assert got[i].kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("text", ["", "\n", "\\", "a\\</s>", "</s>[INST] ok [/INST]", "\\\\[INST]\\", "<s><s>\n</s>", "é\n\n"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "</s>\n\\b"])
def test_turns_read_back(role, text):
    out = render(role, text)
    assert [t[:2] for t in parse(out + render("user", "x"))] == [(role, text), ("user", "x")]


def test_chat_digests(spark):
    turns = [(1, 0, "user", "hi</s>"), (1, 1, "assistant", "yo[INST]"), (1, 2, "assistant", None), (None, None, None, None)]
    got = {r.conv_id: r for r in read_back(format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi</s>\nassistant\nyo[INST]\nassistant\n\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 8, hashlib.sha256(b"yo[INST]").hexdigest())
    assert got[None].n_turns == 1


def test_reparameterised_items_are_found(spark):
    item = "A train leaves the station at 40 km and meets another after 3 hours on the way to the big old harbour in 40 minutes"
    other = item.replace("40", "75").replace("3", "9")
    mixed = item.replace("40 km", "75 km").replace("3", "9")
    clean = "nothing of the kind is said in this text about ships and their crews on a long way home"
    rows = docs_of(spark, [(1, "Well. " + item), (2, "x y. " + other + " end"), (3, clean), (4, None), (5, "")])
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: r for r in contaminated(rows, items).collect()}
    assert set(got) == {1, 2} and got[2].n_slots > 0
    assert contaminated(docs_of(spark, [(6, mixed)]), items).count() == 0
    assert contaminated(rows.limit(0), items).count() == 0
    named = "In spring Anna Berg and Carl Dahl walk with Anna from the town of Lund to the sea. Is it far for Carl and her?"
    cases = docs_of(spark, [(1, "so. " + named), (2, "WE SAY " + named.upper()), (3, "we say " + named.lower()), (4, "so " + named.replace("Anna", "Eva").replace("Carl", "Finn")), (5, clean.upper())])
    assert {r.doc_id for r in contaminated(cases, spark.createDataFrame([(7, named)], "item_id long, text string")).collect()} == {1, 2, 3, 4}


def test_mixing_keeps_every_row_and_the_limit(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    e = epochs_at(tokens, solve_exponent(tokens, max_epochs=4.0))
    assert e["a"] == 1 and abs(e["c"] - 4) < 1e-6
    rows = docs_of(spark, [(i, "w " * (1 + i % 7)) for i in range(200)] + [(None, None)])
    got = mix_sources(rows).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in rows.collect()}
    assert mix_sources(rows.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><nav>Menu</nav><article><h1>T &amp; U</h1><p>one <b>t</b>wo<p>three<div class='comments'>no</div></article><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(1, "http://h/x", page), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == {1: "T & U one two three", 2: ""}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[10:20] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (401, [float("nan")] * 8), (402, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(int)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(df, df.where("vec_id % 50 = 0")).collect()}
    for i in range(0, 300, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert len(got) == 30


def test_language_quality_and_shards_on_odd_rows(spark):
    rows = docs_of(spark, [(1, None), (2, ""), (3, "12 34"), (None, "abc"), (4, "abc"), (4, "abc")])
    model = fit_languages(rows, "text", "lang", "doc_id")
    got = [(r.doc_id, r.lang_pred) for r in identify_languages(rows, model, keep=["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (4, "en")], key=str)
    assert score_quality(rows, None).count() == 6
    assert byte_shards(rows, 2).count() == 6 and byte_shards(rows.limit(0)).count() == 0


def test_top_k_with_many_equal_values():
    x = np.array([[3, 9], [3, 0], [9, 2], [0, 0]])
    assert [(list(i), list(s)) for _, i, s in read_lists(x, np.arange(4), np.array([[1, 1]]), np.array([9]), 1)] == [([0], [12])]
    rng = np.random.default_rng(11)
    for n, width, values, k in [(400, 2, 4, 1), (700, 3, 12, 5), (300, 6, 3, 5), (5, 2, 2, 5)]:
        x, q = rng.integers(-values, values, (n, width)), rng.integers(-3, 4, (60, width))
        for j, ids, scores in read_lists(x, np.arange(n), q, np.arange(60), k):
            best = sorted((-int(q[j] @ x[i]), i) for i in range(n) if i != j)[:k]
            assert [(-s, i) for s, i in zip(scores, ids, strict=True)] == best


def test_html_style_tree(spark):
    def text_of(pages):
        rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
        return [r.text for r in extract_text(rows).orderBy("page_id").collect()]

    heads = ["Methods", "Results", "Data", "Limits", "Notes"]
    # Few distinct headings, whatever the number of pages; the notice in an unnamed div is on all of them.
    for n in (20, 400):
        pages = [(f"http://h/{i}", f"<body><article><h2 class='sec'>{heads[i % 5]}</h2><p class='k'>{heads[i % 3]}</p><p>text {i}</p><div>All rights kept.</div></article></body>") for i in range(n)]
        assert text_of(pages) == [f"{heads[i % 5]} {heads[i % 3]} text {i}" for i in range(n)]
    # Copies of a page are no evidence.
    copies = [("http://c/", "<body><div class='content'>same</div></body>")] * 90 + [(f"http://c/{i}", f"<body><div class='content'>own {i}</div></body>") for i in range(10)]
    assert text_of(copies) == ["same"] * 90 + [f"own {i}" for i in range(10)]
    # No article: a menu and a notice in plain elements go, a text of one page stays where others hold the same.
    plain = [(f"http://p/{i}", f"<body><ul><li>Home<li>News</ul><table><tr><td>We are closed.</table><div><p>page {i}</p></div><div id='x'>{'own' if i == 7 else 'none'}</div></body>") for i in range(60)]
    assert text_of(plain) == [f"page {i}" + (" own" if i == 7 else "") for i in range(60)]
    # Words of a state, and words on an article.
    state = "<body class='menu-open'><div class='has-sidebar no-comments'><article class='comment-page share'>kept <div class='share'>no</div></article></div></body>"
    assert text_of([("http://s/", state)]) == ["kept"]


def test_names_at_sentence_starts_and_equal_numbers(spark):
    tom = "Tom has 3 apples. Tom buys 2 more. How many apples does Tom have?"
    fruit = "A basket holds 2 apples and another basket holds 2 pears while both of them stand on one table in the hall"
    short = "Anna sings."
    items = spark.createDataFrame([(1, tom), (2, fruit), (3, short)], "item_id long, text string")
    texts = [tom.replace("Tom", "Ann"), tom.replace("Tom", "Ann", 1).replace("Tom", "Bob"), fruit.replace("2 apples", "5 apples").replace("2 pears", "7 pears"), fruit.replace("2 pears", "7 pears")]
    texts += [tom.replace("Tom", "Ann").upper(), "Eva sings.", "The dog and the cat of Tom have 3 apples and buy 2 more as they do have many"]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(spark, [*enumerate(texts)]), items).collect()}
    assert got == {(0, 1), (2, 2), (5, 3)}


def test_ngram_links_against_all_pairs(spark):
    rows = [*corpus(), (None, "a b c d e f")]
    rows += [(200 + i, " ".join(f"v{j}" if j != 20 * i else "z" for j in range(80))) for i in range(4)]  # all linked with each other
    rows.append((300, rows[-1][1]))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split() if i not in (103, 104) else t.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    kinds = {s for i, s in sets.items() if s and i is not None}
    linked = {s: [o for o in kinds if o != s and 100 * len(s & o) >= 80 * len(s | o)] for s in kinds}
    links, members = ngram_links(docs_of(spark, rows))
    got = members.collect()
    assert {r.doc_id: r.n_links for r in got} == {i: None if i is None else len(linked.get(s, [])) for i, s in sets.items()}
    of = {r.key: sets[r.doc_id] for r in got if r.doc_id is not None and r.key is not None}
    found = [(frozenset((of[r.a], of[r.b])), r.shared) for r in links.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(frozenset((s, o)), len(s & o)) for s in kinds for o in linked[s]}
    assert max(len(o) for o in linked.values()) >= 3


def test_mixing_orders_blocks_anew_in_each_epoch(spark):
    rows = spark.createDataFrame([(i, f"w {i}", "en", "big" if i % 9 else "small", 1) for i in range(3000)], SCHEMA)
    orders = {}
    for r in mix_sources(rows).select("source", "mix_epoch", "mix_block", "mix_position").distinct().collect():
        assert orders.setdefault((r.source, r.mix_epoch), {}).setdefault(r.mix_position, r.mix_block) == r.mix_block
    assert all(sorted(o) == list(range(len(o))) and len(set(o.values())) == len(o) for o in orders.values())
    first, second = ([b for _, b in sorted(orders["small", e].items())] for e in (0, 1))
    assert sorted(first) != first and first[: len(second)] != second


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    a, b, leak = (" ".join(f"{c}{i}" for i in range(30)) for c in "abx")
    rows = docs_of(spark, [(2, a), (5, a), (5, b), (5, b), (None, b), (None, leak), (None, leak), (None, "")])
    kept = near_copies(spark, rows, None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, a), (5, b), (None, leak), (None, "")], key=str)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(((r.doc_id, r.text) for r in benchmark_leaks(spark, kept, str(tmp_path)).collect()), key=str) == sorted([(2, a), (5, b), (None, "")], key=str)
