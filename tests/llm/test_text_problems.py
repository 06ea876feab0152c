"""Problems 6 to 8: brute force, round trips, planted cases."""

import bisect
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import bpe, pack, residue, tokens
from lodeline.llm.cells import CODE, OUTPUT, TEXT, cells


@pytest.fixture(scope="module")
def code():
    return tokens.encoder()


def plain_merges(ranks, word):
    """The textbook loop: merge the leftmost pair of least rank until there is none."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 30:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


PIECES = ["a", "aa", "the ", "1", "’s", "'s", "'", "'ll", "'re", "'v", "'l", "r", "e", "l", "s", "t", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "漢", "ab", "zz", "​", "𝓜", "½", "२", "'S", "<|endoftext|>", "﻿"]


def test_words_are_the_patterns(code):
    import regex

    rng = random.Random(1)
    find = regex.compile(bpe.PATTERN).findall
    for _ in range(2000):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 10))) for _ in range(rng.randint(1, 4))]
        joined = "".join(texts)
        if not joined:
            continue
        borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = bpe.word_starts(bpe.code_points(joined), borders[:-1][np.diff(borders) > 0]).tolist()
        assert [joined[i:j] for i, j in zip(starts, [*starts[1:], len(joined)], strict=True)] == [w for t in texts for w in find(t)], texts


def test_ids_against_brute_force(code):
    import regex

    ranks = bpe.read_ranks(tokens.RANKS)
    rng = random.Random(2)
    find = regex.compile(bpe.PATTERN).findall
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "a" * 700, "ab" * 300 + "c", " " * 300 + "x", "\n\n  \n"]
    ids, offsets = code.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [x for w in find(t) for x in plain_merges(ranks, w.encode())], repr(t)
    assert code.lengths(texts).tolist() == np.diff(offsets).tolist()


def test_ids_against_the_public_library(code):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(tokens.RANKS)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4F00), rng.randint(0x1F300, 0x1F5FF)])) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["x" * 20_000, "<|endoftext|>"]
    ids, offsets = code.encode(texts)
    for i, t in enumerate(texts):
        got = ids[offsets[i] : offsets[i + 1]].tolist()
        assert got == own.encode_ordinary(t)
        assert got == other.encode(t, add_special_tokens=False).ids
        assert own.decode_bytes(got) == t.encode()  # round trip


def test_long_words_and_full_cache(code, monkeypatch):
    own = bpe.Encoder(bpe.read_ranks(tokens.RANKS))
    monkeypatch.setattr(bpe, "CACHE", 10)
    texts = [f"word{i} {'z' * (i * 40)}" for i in range(40)]
    a = [own.encode([t])[0].tolist() for t in texts]
    b = [code.encode([t])[0].tolist() for t in texts]
    assert a == b


def test_words_with_equal_sums_are_told_apart(code, monkeypatch):
    own = bpe.Encoder(bpe.read_ranks(tokens.RANKS))
    monkeypatch.setattr(bpe, "word_sums", lambda points, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(3))
    for texts in (["one two six ten", "longer words alike", "two", "z"], ["ten one", "x" * 3000 + " " + "y" * 3000]):
        assert own.encode(texts)[0].tolist() == code.encode(texts)[0].tolist()


def test_token_ids_in_spark(spark):
    df = spark.createDataFrame([(1, "Hello  world's end", 5), (2, "", 5), (3, None, 5), (4, "x" * 100_000, 5)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert got[2] == [] and got[3] == []
    assert b"".join({v: k for k, v in bpe.read_ranks(tokens.RANKS).items()}[i] for i in got[1]) == b"Hello  world's end"
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


# ---- 7


def check_packing(sizes, capacity):
    container, item, first, size = pack.pack(np.array(sizes), capacity)
    sums = np.bincount(container, size) if len(container) else np.zeros(0)
    assert (sums <= capacity).all()
    for i, s in enumerate(sizes):
        own = sorted(zip(first[item == i].tolist(), size[item == i].tolist(), strict=True))
        assert sum(x for _, x in own) == s
        assert s > capacity or len(own) == 1
        at = 0
        for a, n in own:
            assert a == at
            at += n
    return len(sums)


def test_packing_is_whole_and_tight():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 64, 512])
        sizes = [rng.choice([0, rng.randint(1, capacity), rng.randint(1, 4 * capacity), capacity]) for _ in range(rng.randint(0, 120))]
        used = check_packing(sizes, capacity)
        least = -(-sum(sizes) // capacity)
        rests = sum(1 for s in sizes if s % capacity)
        assert used <= max(1, least + 1 + rests // 4) or used <= least * 11 / 9 + 4
    assert check_packing([], 10) == 0 and check_packing([0, 0], 10) == 1


def test_every_window_is_differenced_and_full(monkeypatch):
    rng = random.Random(8)
    for capacity, draw in ((512, lambda: rng.randint(1, 512)), (512, lambda: rng.choice([rng.randint(1, 60), rng.randint(200, 512)])), (2048, lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1))):
        sizes = np.array([draw() for _ in range(3000)])
        window = pack.windows(sizes, capacity)
        assert np.bincount(window, sizes).max() <= capacity
        gaps, best = [], 0  # best fit, the largest first, as a yardstick
        for size in sorted(sizes.tolist(), reverse=True):
            at = bisect.bisect_left(gaps, size)
            best += at == len(gaps)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            if gap > size:
                bisect.insort(gaps, gap - size)
        assert int(window.max()) + 1 <= best * 1.003 + 1
    # the windows are those differencing gives: where it puts all items into one window, nothing fits but one item each
    monkeypatch.setattr(pack, "differencing", lambda sizes, k: (np.zeros(len(sizes), np.int64), np.array([sizes.sum()])) if k < len(sizes) else (np.arange(len(sizes)), sizes))
    assert int(pack.windows(np.full(40, 300), 512).max()) + 1 == 40
    assert int(pack.windows(np.array([100, 100]), 512).max()) + 1 == 1


def test_differencing_balances():
    sizes = np.array([8, 7, 6, 5, 4])
    window, sums = pack.differencing(sizes, 2)
    assert sorted(sums.tolist()) == [14, 16]  # the known result of the method
    assert np.bincount(window, sizes).tolist() == sums.tolist()
    window, sums = pack.differencing(np.array([3, 3, 3, 3, 3, 3]), 3)
    assert sums.tolist() == [6, 6, 6]
    window, sums = pack.differencing(np.array([5, 4]), 1)
    assert sums.tolist() == [9]


def test_containers_in_spark(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, rng.randint(1, 90), 250]) for i in range(300)}
    items = spark.createDataFrame([(i, n, "clash") for i, n in sizes.items()] + [(None, 5, ""), (999, None, "")], "doc_id bigint, n_tokens bigint, shard string")
    budgets = spark.createDataFrame([(1, 100), (2, 1000), (3, None), (4, 0)], "budget_id int, capacity_tokens int")
    out = pack.assign(items, budgets, shard=50)
    for budget, capacity in ((1, 100), (2, 1000)):
        mine = out.where(F.col("budget_id") == budget)
        assert {r["doc_id"]: r["n"] for r in mine.groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()} == sizes
        assert mine.groupBy("container_id").agg(F.sum("tokens").alias("n")).where(F.col("n") > capacity).count() == 0
    assert out.select("budget_id").distinct().count() == 2
    assert pack.assign(items.limit(0), budgets).count() == 0
    assert pack.fill_report(out).count() == 2


# ---- 8

SLOTS = [
    "Dear [insert  author  name],", "<your लेखक here>", "#\xa0{{\xa0team\xa0}}", "{% block\ncontact %}{% endblock %}", "In this notebook <your project\nhere> describes it.", "${goal} and ${team}", "$(题名)", "~~題名~~ (fill in) x",
    "@@x@@", "%%AUTOR%%", "<%= team %>", "(add results here)", "## [[लेखक]]", "%(title)s", "[TBD]", "{{cookiecutter.some_name}}", "<<short summary of what was found in the data of the whole year>>", "<%= " + "a.b " * 60 + "%>",
]
SAID = [
    "(sample text)", "Sample text.", "blah blah blah …", "xxx xxx xxxx.", "asdf hjkhjk", "Loading... It looks like script execution is\nblocked. Allow", "429 You do not have\npermission to view this notebook (ref d2)", "<h1>This share link has expired</h1>",
    "texte à venir:", "Lorem ipsum dolor sit amet vellum", "SERVICE  IS  DOWN FOR MAINTENANCE", "您的浏览器已禁用脚本。", "> HTTP 410\n> Accès refusé",
]
#: Common messages of servers, frameworks and templates, beside those of the test corpus.
UNSEEN = [
    "Access denied", "403 Forbidden: you cannot access this resource", "Internal Server Error", "502 Bad Gateway", "Please turn on JavaScript to view this page", "Enable JavaScript and cookies to continue", "JavaScript must be enabled to use this application",
    "Oops! That page can't be found.", "Click here to add text", "YOUR TEXT HERE", "The requested URL was not found on this server.", "Sorry, the page you are looking for does not exist.", "504 Gateway Time-out", "An unexpected error occurred.", "Diese Seite existiert nicht.",
    "JavaScript ist in Ihrem Browser deaktiviert", "Cette page n'existe pas", "Veuillez activer JavaScript", "Por favor, habilite JavaScript", "Página não encontrada", "Страница не найдена", "页面不存在", "ページが見つかりません", "Type your text here", "Dummy content", "Votre texte ici", "Введите текст", "ここにテキストを入力",
]
NO = [
    "A slot such as `{{ name }}` or `${name}` is replaced when the page is built.", "A slot such as `{{\nname }}` is", "$$\\hat{y}_{i} = \\beta_{0} + x^{{3}}$$", "Set $x_{i}$ to 8 and $\\frac{a}{b}$ below; see `__init__` of k.", "The log shows \"page\nnot found\" 217 times", "Rows with `asdf` or `xxx` are dropped.",
    "The pseudo-Latin string above only tests the word counter.", "Dashboards run without JavaScript once exported.", "We count how many requests ended in 404 or 503 per hour; x", "[text](http://a.b)", "**bold** [1]", "a table of sample text lengths", "{1, 2}", "aaaaaaaaaa", "don't we'll I'M",
    "Wert Wert Übersicht", "Todo: bird counts", "The script needs two arguments", "$" + "x_{i} + " * 100 + "1$ and {{3}}", '"' + "page not found, " * 40 + '"',
]


def kinds(message):
    return {k for _, k, proof in residue.fragments_of(message, {}) if proof}


def test_rules():
    assert [x for x in SLOTS if residue.SLOT not in kinds(x)] == []
    assert [x for x in SAID + UNSEEN if not kinds(x)] == []
    assert [(x, kinds(x)) for x in NO if kinds(x)] == []


def test_names_of_looser_slots():
    assert [(s, n, k) for x in ("## __शीर्षक__", "«title»", "{Some-Name}") for s, n, k in residue.slots(x)] == [("__", "शीर्षक", residue.LOOSE), ("«", "title", residue.LOOSE), ("{", "some name", residue.LOOSE)]


def test_cells():
    percent = "# %% [markdown]\r\n# Text {{ a }}\r\n\r\n# %% [1]\r\nx = '<your x here>'\r\n\r\n# %% [output:text]\r\n#> 404 File is too big to display\r\n"
    assert [k for k, _ in cells(percent)] == [TEXT, TEXT, CODE, OUTPUT]
    rendered = "# Title\n\nIn [1]:\n    cfg = '<your x here>'\n\n    y = 1\n\nOut[1]:\n404 This share link has expired\n\nText\n\n[error]\n----\nKeyError\n\nMore"
    assert [(k, t.strip()) for k, t in cells(rendered)] == [(TEXT, "# Title"), (CODE, "cfg = '<your x here>'\n\n    y = 1"), (OUTPUT, "404 This share link has expired"), (TEXT, "Text"), (OUTPUT, "----\nKeyError"), (TEXT, "More")]
    book = "﻿" + json.dumps({"cells": [{"cell_type": "markdown", "source": ["a", "b"]}, {"cell_type": "code", "source": "c", "outputs": []}, 5]})
    assert cells(book) == [(TEXT, "ab"), (CODE, "c")]
    assert cells(None) == cells("") == cells(" \xa0\n") == []
    assert cells("# %%TEAM%% here") == [(TEXT, "# %%TEAM%% here")]
    assert cells('{"a": 1}') == [(TEXT, '{"a": 1}')]


def spread(messages, n=6, first=0):
    """Each message in n documents of n sources, each with text of its own."""
    return [(first + n * k + i, f"Tide levels of station {chr(97 + i)}{chr(97 + k % 26)} were read.\n\n{x}", f"s{i}") for k, x in enumerate(messages) for i in range(n)]


def found(spark, docs, **limits):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("fragment", F.lit(1)).withColumn("kind", F.lit("x"))
    return {r["doc_id"] for r in residue.flagged(df, **limits).collect()}


def test_found_in_spark(spark):
    yes, no = spread(SLOTS + SAID + UNSEEN), spread(NO, first=10_000)
    rest = [(20_000, None, "s"), (20_001, "", "s"), (20_002, " \n", "s"), (20_003, "In [1]:\n    t = '{{ x }}'\n\nOut[1]:\nThis share link has expired\n", "s")]
    assert found(spark, yes + no + rest) == {d for d, _, _ in yes}
    df = spark.createDataFrame(yes + rest, "doc_id bigint, text string, source string")
    assert residue.flagged(df.limit(0)).count() == 0
    assert residue.exclude(df, min_documents=5).count() == len(rest)


def test_groups_decide(spark):
    """A message counts where it recurs in documents and sources; masks make messages equal; the groups aren't bypassed by any rule."""
    one = [(i, f"# 50{i} This link has expired (ref a{i}f{i})", f"s{i % 3}") for i in range(5)]
    assert found(spark, one) == set(range(5))
    assert found(spark, one[:4]) == set()  # too few documents
    assert found(spark, [(i, t, f"s{i % 2}") for i, t, _ in one]) == set()  # too few sources
    assert found(spark, one[:3], min_documents=3) == {0, 1, 2}
    noise = [(i, t, f"s{i}") for i, t in enumerate(["qwer asdf", "zxcv dfgdfg qwerty", "asdf zxcv", "hjkhjk asdf qwer", "dfg sdfsdf"])]
    assert found(spark, noise) == set(range(5))
    # in most of its documents it is part of a longer text, so it isn't what stands there
    long = "The monthly report says that the levels rose slowly and that all stations were read by hand in spring."
    inside = [(i, f"{long} Access denied. {long}" if i < 7 else "Access denied", f"s{i}") for i in range(13)]
    assert found(spark, inside) == set()
    assert found(spark, inside[2:]) == set(range(2, 13))  # now it stands alone in most, and counts wherever it is


def test_looser_slots_need_a_templates_name(spark):
    sure = [(i, f"By {{{{team}}}} {i}", f"s{i}") for i in range(5)]
    loose = [(10, "Written by {team}", "a"), (11, "«team» and more", "b"), (12, "Values of {set}", "c"), (13, "See __team__", None)]
    assert found(spark, sure + loose) == {0, 1, 2, 3, 4, 10, 11, 13}
    assert found(spark, sure[:4] + loose) == set()


def test_sources_are_counted_exactly(spark):
    rows = spark.createDataFrame([(i, None if i == 0 else "" if i == 1 else f"s{i}", 7, 1, i % 2 == 0, None) for i in range(100)] + [(200, "s5", 7, 1, True, None)], "doc_id bigint, source string, fragment bigint, kind int, proof boolean, sample string")
    assert [(r["documents"], r["sources"], r["proofs"], r["proof_sources"]) for r in residue.recurrence(rows).collect()] == [(101, 99, 51, 51)]


def test_masking():
    assert [s for s, _ in residue.sentences("Ref 12ab at 2017-03-01T10:00:00Z from 10.0.0.1, see https://x.y/z [4711] HTTP 404 Gone. Done (id 5) Next")] == ["ref at from see", "gone", "done", "next"]
