"""The ten operators against brute force, exact round trips, held-out labels and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import chat_format, decontaminate, html_extract, induced_sort, language_id, mixing, ngram_join, quality_classifier, quality_rules, registry, sharding, suffix_dedup
from tests.comparing import TABLES, both, oracle

SF = f"{TABLES}/sf0.001"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, signs of other alphabets."""
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", "a"), (5, "one", "b"), (6, "ONE two three é 漢字 🙂", None), (7, long_, "b"), (8, long_ + " end", "b"), (9, "dup row here and there", "c"), (9, "dup row here and there", "c")]
    return texts_of(spark, rows)


def empty(spark):
    return texts_of(spark, []).withColumn("score", F.lit(1)).withColumn("size", F.lit(1)).withColumn("shard", F.lit(1))


def random_texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 60, 100]))]
        rows.append((i, " ".join(words), "s"))
    return rows


# --- 1 -----------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    got = registry.QUERIES["op1_bradley_terry"](spark, f"{TABLES}/sf0.01").toPandas()
    labels = pd.read_parquet(f"{TABLES}/sf0.01/labels.parquet")
    both_ = got.merge(labels, on="doc_id")
    held = both_[both_.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    rates = [(held[held.quality == q].predicted == q).mean() for q in (0, 1)]
    assert min(rates) > 0.9, rates


def test_quality_odd_inputs(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(odd(spark), labels)
    assert quality_classifier.score(odd(spark), model).count() == 10
    assert quality_classifier.score(empty(spark), model, ["doc_id", "score", "lang"]).count() == 0
    none = quality_classifier.train(odd(spark), labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd(spark), none).collect()} == {0.5}


# --- 2 -----------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    got = registry.QUERIES["op2_offset_masks"](spark, SF).toPandas().set_index("conv_id")
    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], columns=["conv_id", "turn", "role", "text"])])
    assert len(got) == rows.conv_id.nunique()
    for conv, part in rows.sort_values("turn").groupby("conv_id"):
        texts = [t or "" for t in part.text]
        every = "".join(f"{r}\n{t}\n" for r, t in zip(part.role, texts, strict=True))
        learned = "".join(t for r, t in zip(part.role, texts, strict=True) if r == "assistant")
        g = got.loc[conv]
        assert (g.n_turns, g.turns_sha256) == (len(part), hashlib.sha256(every.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "[\\\\INST] x [/INST]", "</s\\>", "<|im_start|>user\nhi<|im_end|>\n", "🙂 é\n\n<s>", "\\<|endoftext|>"])
def test_chat_escapes(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    turns = [("user", text), ("as\nsis\\tant", text), ("assistant", text)]
    assert chat_format.parse(chat_format.render(turns)[0]) == turns


def test_chat_odd_inputs(spark):
    rows = spark.createDataFrame([(None, 0, "user", None, 1), (1, 0, None, "x", 1), (1, 0, None, "x", 1), (1, None, "assistant", "", 1)], "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.digests(chat_format.format_conversations(rows)).collect()
    assert {(r.conv_id, r.n_turns) for r in out} == {(None, 1), (1, 3)}
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


def test_loss_mask_of_empty_texts():
    offsets = np.array([(0, 3), (3, 6), (6, 9)])
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in chat_format.loss_mask(offsets, [(4, 4)])] == [[False] * 3, []]
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in chat_format.loss_mask(offsets, [(4, 5), (6, 6), (7, 9)])] == [[False, True, True], [(4, 5), (7, 9)]]


# --- 3 -----------------------------------------------------------------------------------------------------------
def test_shards(spark):
    got = registry.QUERIES["op3_feistel_shards"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    by = got.merge(docs, on="doc_id")
    assert (by["size"] == by.text.map(lambda t: len(t.encode()) + 1)).all() and (by.text_crc32 == by.text.map(lambda t: zlib.crc32(t.encode()))).all()
    again = registry.QUERIES["op3_feistel_shards"](spark, SF).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_shards_odd_inputs(spark):
    for n in (1, 2, 17, 100):
        out = sharding.shard_rows(spark.range(n).withColumn("shard", F.lit("x")), 4).toPandas()
        assert len(set(zip(out.shard, out.slot, strict=True))) == n and out.groupby("shard").size().max() - (n // 4) <= 1
    out = sharding.sharded(odd(spark)).toPandas()
    assert len(out) == 10 and len(set(zip(out.shard, out.slot, strict=True))) == 10
    assert sharding.sharded(empty(spark)).count() == 0


def test_places_are_the_permutation(spark):
    """Places are recomputed from the row numbers: hash, rounds and walk."""
    import struct

    def h(value, seed, i):
        x = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
        for v in (seed, i):
            x = xxhash.xxh64_intdigest(struct.pack("<i", v), x)
        return x - (x >> 63 << 64)

    for n in (1, 2, 5, 97, 300):
        numbered = {r.id: r.no for r in sharding.number_rows(spark.range(n), "no").collect()}
        assert sorted(numbered.values()) == list(range(n))
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        for r in sharding.shard_rows(spark.range(n), 4).collect():
            at = numbered[r.id]
            while True:
                left, right = divmod(at, b)
                for i in range(0, sharding.ROUNDS, 2):
                    left = (left + h(right, 11, i) % a) % a
                    right = (right + h(left, 11, i + 1) % b) % b
                at = left * b + right
                if at < n:
                    break
            assert (r.shard, r.slot) == (at % 4, at // 4)


# --- 4 -----------------------------------------------------------------------------------------------------------
def test_made_pages_are_read():
    """Held-out made-up pages: nearly every block gets its label."""
    model, rng, right, total = html_extract.trained(400), random.Random(77), 0, 0
    for _ in range(100):
        html, truth = html_extract.made_page(rng)
        found = html_extract.leaves(html)
        if len(found) == len(truth):
            x, _, _ = html_extract.padded([html_extract.vectors(found)])
            right += ((model.score(x, np.ones(x.shape[:2], np.float32)) > 0)[:, 0] == truth).sum()
            total += len(truth)
    assert right / total > 0.96


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>t</title><body><article><p>one</article>", ["one"]),
        ("<html><head><title>t</title><meta charset=x><script>s</script><article><p>one</p></article>", ["one"]),
        ("<head><title>t</title><noscript><link></noscript><template><p>no</p></template><style>s</style><p>one", ["one"]),
        ("<head><title>t</title>one<p>two", ["one", "two"]),
        ("<head><title>t</title><img>one<p>two", ["one", "two"]),
        ("<head><title>t</title><br/>one", ["one"]),
        ("<head><noscript><link><body><p>one", ["one"]),
        ("<body><div><select><option>no<p>one</p><p>two</p></div>", ["one", "two"]),
        ("<body><noscript>no<img><div>one</div><noscript><p>no</p></noscript><p>two", ["one", "two"]),
        ("<body><noscript><div><p>no</p></div></noscript><svg><title>no</title></svg><p>one", ["one"]),
        ("<head><title>t</title></head><body><select><option>no<option>no</select><p>one</p>", ["one"]),
    ],
)
def test_pages_with_silent_elements_left_open(html, want):
    assert [t for _, t, _ in html_extract.leaves(html)] == want


SAID = [f"Plain sentence number {i} stands here and says a little more." for i in range(10)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SAID)
LINKED = "".join(f"<p><a href='/{i}'>{x}</a></p>" for i, x in enumerate(SAID))
MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(6)) + "</ul></nav>"


@pytest.fixture(scope="module")
def labeller():
    return html_extract.trained()


@pytest.mark.parametrize(
    ("html", "also"),
    [
        (f"<html><body><div><div>{PARAGRAPHS}</div></div></body></html>", []),
        (f"<html><head><title>x</title></head><body>{MENU}<div id='main-col'>{PARAGRAPHS}</div><footer>&copy; 2024 Someone</footer></body></html>", []),
        (f"<html><head><title>t</title><body><article>{PARAGRAPHS}</article>", []),
        (f"<html><body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>About us</a></td><td>{PARAGRAPHS}</td></tr></table></body></html>", []),
        (f"<body><h1>Title of it</h1>{PARAGRAPHS}</body>", ["Title of it"]),
        ("<html><body><div class='topbar'><a href=/>Home</a> <a href=/n>News</a></div><div class='wrapper'><div class='xyz'>" + "".join(f"<div>{x}</div>" for x in SAID) + "</div></div><div class='footer'>Copyright 2024</div></body></html>", []),
        (f"<html><body><main><h1>Head</h1>{PARAGRAPHS}</main><section id=comments><p>I like this very much. Thank you.</p></section></body></html>", ["Head"]),
        (f"<html><body><form id='aspnetForm' action='x.aspx'>{MENU}<div id='content'>{PARAGRAPHS}</div><footer>&copy; 2024 Someone</footer></form></body></html>", []),
        (f"<html><body><form id='aspnetForm'><article>{PARAGRAPHS}</article></form></body></html>", []),
        (f"<html><body>{MENU}<article>{LINKED}</article><footer>&copy; 2024 Someone</footer></body></html>", []),
        (f"<html><body><article>{PARAGRAPHS}</article><ul class='commentlist'><li>I like this very much. Thank you.</li><li>So do I.</li></ul></body></html>", []),
        (f"<html><body><article>{PARAGRAPHS}</article><div><h3>3 Comments</h3><p>I like this very much. Thank you.</p><p>Me too, it is good.</p></div></body></html>", []),
        (f"<html><body><div>This site uses cookies to serve you better.</div>{MENU}<div class=content>{PARAGRAPHS}</div></body></html>", []),
    ],
)
def test_pages_written_by_hand(labeller, html, also):
    """Layouts that the generator of the training pages does not copy: all sentences stay, menus, footers and comments go."""
    assert sorted(html_extract.main_texts(labeller, [html])[0].split("\n")) == sorted(SAID + also)


def test_pages_of_one_short_block(labeller):
    pages = ["<html><body><div id=main><p>One short paragraph.</p></div></body></html>", f"<html><body>{MENU}<div id=main><p>One short paragraph of it.</p></div><footer>&copy; 2024 Someone</footer></body></html>"]
    assert html_extract.main_texts(labeller, pages) == ["One short paragraph.", "One short paragraph of it."]


def test_articles_of_the_table(labeller):
    pages = pd.read_parquet(f"{TABLES}/sf0.01/pages.parquet").html.fillna("").tolist()
    want = ["\n".join(t for path, t, _ in html_extract.leaves(h) if any(p[0] == "article" for p in path)) for h in pages]
    assert sum(a == b for a, b in zip(html_extract.main_texts(labeller, pages), want, strict=True)) == len(pages)


def test_a_very_long_page(labeller):
    long_ = "<article>" + "".join(f"<p>Paragraph {i} of a very long page says this.</p>" for i in range(12_000)) + "</article>"
    assert html_extract.main_texts(labeller, [long_])[0].count("\n") == 11_999


def test_pages_odd_inputs(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>a &amp; b&nbsp;&eacute;\n c <b>d</b></p><p>One more sentence here.</p><script>x</script></article>"), (4, "u", "<div <<p>>broken"), (None, "u", "<nav><li>Home</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert len(out) == 5 and out[1] == "" and out[2] == "" and out[3] == "a & b é c d\nOne more sentence here."
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------
def test_rules_equal_sql(spark):
    got, want = both(spark, oracle(SF), registry.QUERIES["op5_host_rules"], registry.ORACLES["op5_host_rules"], SF)
    assert got == want


def test_rules_brute_force(spark):
    docs = odd(spark).union(texts_of(spark, [(20, "a b c d e f g h " * 5 + "x\nq\nq\n \nq", "z"), (21, "k " * 30, "z")]))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = pd.Series(runs, dtype=object).value_counts().to_dict() if runs else {}
        inside = {i + j for i, g in enumerate(runs) if seen[g] > 1 for j in range(8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(words), len("".join(words)), len(lines) - len(set(lines)), len(inside))
    assert quality_rules.judge(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("hosts", "rejected"),
    [
        # equal rates: what two documents each tell is chance, and no host is rejected for it
        ([(2, [0, 1, 1, 2][i % 4]) for i in range(1000)], set()),
        ([*((20, 1 + i % 3) for i in range(200)), (1000, 950)], {200}),
        # one row a host tells nothing about hosts
        ([(1, i % 2) for i in range(1000)], set()),
        ([*((1, i % 2) for i in range(1000)), (1000, 300)], set()),
        ([(50, 5)] * 30 + [(50, 48)] * 10, set(range(30, 40))),
        ([(40, 39)], {0}),
    ],
)
def test_host_prior_takes_chance_off(spark, hosts, rejected):
    rows = [(f"h{i}", j < f) for i, (n, f) in enumerate(hosts) for j in range(n)]
    got = quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).filter("host_rejected").collect()
    assert {int(r.host[1:]) for r in got} == rejected


# --- 6 -----------------------------------------------------------------------------------------------------------
def brute_removed(texts, length):
    seen: dict = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    cut = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cut[d][i : i + length] = True
    return cut


@pytest.mark.parametrize(("length", "grams", "hot"), [(40, (20, 40), 1 << 21), (60, (20, 50, 60), 1 << 21), (60, (20, 50, 60), 300), (40, (20,), 1)])
def test_substrings_brute_force(spark, monkeypatch, length, grams, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.choice([30, 45, 80, 200]))) for _ in range(6)]
    texts = [None, "", "aaaa" * 40, "ab" * 70, "x" * (length - 1)]
    texts += ["".join(rng.choice([rng.choice(passages), "".join(rng.choice("efgh") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts += [texts[7], texts[7]]
    # one passage in very many different contexts
    texts += ["".join(rng.choice("efgh") for _ in range(30)) + passages[0][: length - 4] + "".join(rng.choice("efgh") for _ in range(30)) for _ in range(60)]
    docs = texts_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    raw = [(t or "").encode() for t in texts]
    cut = brute_removed(raw, length)
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(docs, length, grams).collect()}
    for i, (t, c) in enumerate(zip(raw, cut, strict=True)):
        want = bytes(np.frombuffer(t, np.uint8)[~c])
        assert bytes(got[i].kept) == want, i
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
        assert got[i].spans == edge.tolist()
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_substrings_null_ids_and_a_very_long_text(spark):
    rng = random.Random(4)
    long_ = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    texts = [(None, long_[:500]), (None, "q" * 399), (3, long_ + long_[-450:]), (None, long_[:500])]
    got = [(r.doc_id, r.n_bytes, r.spans) for r in suffix_dedup.deduplicate(texts_of(spark, [(i, t, "s") for i, t in texts])).collect()]
    n = len(long_)
    assert sorted(got, key=str) == sorted([(None, 500, [0, 500]), (None, 399, []), (3, n + 450, [0, 500, n - 450, n + 450]), (None, 500, [0, 500])], key=str)


@pytest.mark.parametrize(("bound", "batch", "cap"), [(3, 2, 1 << 30), (10, 7, 4), (50, 30, 1 << 30), (1 << 18, 1 << 17, 9)])
def test_suffix_order_from_disk(tmp_path, bound, batch, cap):
    """Orders and common prefixes against sorted suffixes, with few tuples in memory, so that queues and files are used."""
    rng, spilled = random.Random(bound), 0
    for turn in range(120):
        text = [rng.randrange(rng.choice([1, 2, 3, 5, 100])) for _ in range(rng.choice([1, 2, 3, 10, 60, 200]))]
        text = [(text[: len(text) // 7 + 1] * 10)[: len(text)], [x for x in text[:20] for _ in range(rng.choice([1, 40]))], text][turn % 3]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        disk = induced_sort.Disk(str(tmp_path), bound, batch)
        got = induced_sort.suffix_order(np.array(text, np.uint16), disk, cap)
        assert got[:, 0].tolist() == order
        for (a, _), (b, n) in zip(got[:-1].tolist(), got[1:].tolist(), strict=True):
            shared = next((k for k in range(min(len(text) - a, len(text) - b)) if text[a + k] != text[b + k]), min(len(text) - a, len(text) - b))
            assert n == min(cap, shared)
        spilled += disk.spilled
    assert bound > 100 or spilled


def test_names_look_again_only_at_ties_that_go_on(tmp_path, monkeypatch):
    """Many equal short substrings beside two equal long ones: the short ones are packed once; names keep the order, at the text's end too."""
    text = np.array([1, 2] * 2000 + [*range(1, 90)] * 2 + [1, 2, 1], np.uint16)
    packed, plain = [], induced_sort._packed
    monkeypatch.setattr(induced_sort, "_packed", lambda *a: packed.append(len(a[-5])) or plain(*a))
    disk = induced_sort.Disk(str(tmp_path))
    order = induced_sort.suffix_order(text, disk)
    assert order[:, 0].tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert sum(packed) < 2 * 2100, packed


# --- 7 -----------------------------------------------------------------------------------------------------------
def brute_components(rows, k, t):
    sets = {}
    for i, text, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "t", "frequent"), [(4, 85, 8192), (5, 80, 8192), (2, 70, 1)])
def test_join_brute_force(spark, monkeypatch, k, t, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = [*random_texts(), (900, None, "s"), (901, "", "s"), (902, "A b", "s"), (903, "a  B", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(texts_of(spark, rows), k, t).collect()}
    assert got == brute_components(rows, k, t)


def test_one_of_each_null_and_repeated_ids(spark):
    text = lambda w, n=40: " ".join(f"{w}{j}" for j in range(n))
    a, b, c, d, e, f = (text(w) for w in "abcdef")
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (None, None), (None, ""), (5, d), (5, a + " more"), (7, e), (7, e + " end"), (8, f), (8, f), (None, f)]
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(texts_of(spark, [(i, t, "s") for i, t in rows])).collect()]
    c_kept, e_kept = [x for x in got if (x[1] or "").startswith("c")], [x for x in got if (x[1] or "").startswith("e")]
    assert len(c_kept) == len(e_kept) == 1
    assert sorted(map(str, set(got) - {*c_kept, *e_kept})) == sorted(map(str, [(1, a), (None, b), (None, None), (None, ""), (5, d), (8, f)])) and len(got) == 8


def test_join_links_through_null_ids(spark):
    words = [f"w{j}" for j in range(60)]
    near = lambda n: " ".join(words[:-n] + [f"x{j}" for j in range(n)])
    rows = [(1, " ".join(words)), (None, near(3)), (2, " ".join([*words[:-3], "x0", "x1", "x2"][3:]))]
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(texts_of(spark, [(i, t, "s") for i, t in rows]), 4, 85).collect()}
    assert got == {1: 1, 2: 1, None: 1}


def test_join_odd_inputs(spark):
    assert ngram_join.join_components(odd(spark)).count() == 10
    assert ngram_join.join_components(empty(spark)).count() == 0
    assert {r.doc_id for r in ngram_join.one_of_each(odd(spark)).collect()} == {1, 2, 3, 4, 6, 7, 9}


# --- 8 -----------------------------------------------------------------------------------------------------------
def test_languages_on_held_out_rows(spark):
    sf = f"{TABLES}/sf0.01"
    got = registry.QUERIES["op8_cross_parsing"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang", "text"]].merge(got, on="doc_id")
    held = docs[docs.held_out & docs.text.map(lambda t: len(t.split()) >= 5)]
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() > 0.95


def greedy_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("piece", [3, 7, 512])
def test_phrases_are_longest_matches(monkeypatch, piece):
    """The joined parses of pieces count what one parse of the whole text counts, with letters the samples lack and texts that never fall into step."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(piece)
    samples = {"a": "abcab cab", "b": "xyz zyx", "c": "a" * 40, "d": "".join(rng.choice("abc ") for _ in range(300)), "e": "漢字 " + "abx" * 20}
    texts = ["aqaqaqaqaq", "abcabxyzab", "a" * 100, "q", "aab" * 30, samples["d"], "漢字字漢q" * 5, *("".join(rng.choice("abcxq 漢") for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    model = language_id.Model(samples)
    codes = [model.codes(t) for t in texts]
    want = [[greedy_phrases(c.tolist() and "".join(map(chr, c + 65)), "".join(map(chr, model.codes(samples[k]) + 65))) for k in model.langs] for c in codes]
    assert model.phrases(codes).tolist() == want
    assert model.phrases([model.codes(samples["d"])])[0, 3] == 1


def test_language_samples_stay_within_their_budget(spark):
    """A corpus of books alone is learned from as few of them as the budget holds; one book beyond it gives its beginning."""
    rng = random.Random(4)
    book = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n // 6))
    rows = [(i, book("abcde", 30_000 + 97 * i), "aa") for i in range(30)] + [(100 + i, book("vwxyz", 150_000), "bb") for i in range(3)] + [(200, "short one", "cc"), (201, "", "dd"), (202, None, "dd"), (203, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.xxhash64("text"))
    sample = language_id.training_sample(frame)
    assert set(sample) == {"aa", "bb", "cc", "dd"} and all(len(t) <= language_id.BUDGET + language_id.TEXTS for t in sample.values())
    assert sum(t in sample["aa"] for _, t, k in rows if k == "aa") == 2 and len(sample["bb"]) == language_id.BUDGET
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame, sample).collect()}
    assert all(got[i] == k for i, t, k in rows if k and t and k in ("aa", "bb"))


def test_languages_odd_inputs(spark):
    samples = {"en": "the cat sat on the mat", "fr": "le chat est sur la table"}
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd(spark), samples).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in samples
    assert language_id.identify(empty(spark), samples).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd(spark), {}).collect()} == {"und"}


# --- 9 -----------------------------------------------------------------------------------------------------------
def wanted_targets(sizes):
    """By repeated sharing: a source over its limit stops there and the rest is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    got = registry.QUERIES["op9_mixed"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "source", "text"]]
    by = docs.merge(got, on="doc_id")
    assert len(by) == len(docs) and (by["size"] == by.text.map(lambda t: len(WORD.findall(t)))).all()
    want = wanted_targets(by.groupby("source")["size"].sum().to_dict())
    for source, part in by.groupby("source"):
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * max(1, want[source])
        assert part.source_size.iloc[0] == part["size"].sum()
        assert abs(part.taken.sum() - want[source]) <= max(50, 0.05 * want[source])
    assert (by.taken <= 3 * by["size"]).all()
    again = registry.QUERIES["op9_mixed"](spark, SF).toPandas()
    assert got[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_mix_odd_inputs(spark):
    got = mixing.mix_documents(odd(spark)).collect()
    assert len(got) == 10 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_mix_shuffles_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("slots", F.lit(1)).withColumn("size", F.lit("x"))
    got = mixing.mix_documents(docs, 4, with_slots=True).toPandas()
    places = [(s, k) for shards, slots in zip(got.shards, got.slots, strict=True) for s, k in zip(shards, slots, strict=True)]
    for shard in range(4):
        assert sorted(k for s, k in places if s == shard) == list(range(sum(s == shard for s, _ in places)))
    assert sum(map(len, got.shards)) == len(places) and (got.shards.map(len) * got["size"] == got.taken).all()
    # neighbours in a shard are not neighbours by id
    ids = sorted((k, i) for i, shards, slots in zip(got.doc_id, got.shards, got.slots, strict=True) for s, k in zip(shards, slots, strict=True) if s == 0)
    assert sum(abs(a[1] - b[1]) < 2 for a, b in zip(ids, ids[1:], strict=False)) < 0.2 * len(ids)
    assert "slots" not in mixing.mix_documents(odd(spark)).columns
    assert mixing.mix_documents(odd(spark), with_slots=True).count() == 10 and mixing.mix_documents(empty(spark), with_slots=True).count() == 0


def test_split_quotas_keep_sums(spark):
    out = mixing.split_quotas(spark.sql("SELECT array(7L, 0L, 33L) AS quotas"), 5, 1).toPandas()
    assert np.sum(out.quotas.tolist(), axis=0).tolist() == [7, 0, 33] and out.quotas.map(sum).tolist() == [8] * 5


# --- 10 ----------------------------------------------------------------------------------------------------------
def brute_found(docs, items):
    """(doc, item) with a window within floor(m / 5) word edits."""
    tokens = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").lower())
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = tokens(item), tokens(text)
            if a and b:
                last = np.zeros(len(b) + 1, int)
                for w in a:
                    now = np.empty_like(last)
                    now[0] = last[0] + 1
                    for j, x in enumerate(b, 1):
                        now[j] = min(last[j - 1] + (x != w), last[j] + 1, now[j - 1] + 1)
                    last = now
                if last.min() <= len(a) // 5:
                    out.add((d, i))
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(["p", "q", "r"]) + str(rng.randrange(80)) for _ in range(n))) for i, n in enumerate([3, 5, 6, 10, 20, 40, 40])]
    docs = []
    for d in range(80):
        words = [f"z{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        item = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12])):
            at, what = rng.randrange(len(item)), rng.random()
            item[at : at + 1] = [] if what < 0.3 and len(item) > 1 else [f"e{rng.randrange(9)}"] if what < 0.7 else [item[at], "extra"]
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + item + words[at:])))
    table = texts_of(spark, [(d, t, "s") for d, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(table, bench).collect()}
    want = brute_found(docs, items)
    assert got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))
    clean = {r.doc_id for r in decontaminate.clean(table, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_insertion_near_the_start(spark):
    item = [f"w{j}" for j in range(8)]
    docs = texts_of(spark, [(1, " ".join([*item[:2], "x", *item[2:]]), "s")])
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, bench).collect()] == [(1, 5, 1, 0, 9)]


@pytest.mark.parametrize("m", [5, 6, 8, 12, 16, 20, 30, 40, 59, 60, 90, 150])
def test_decontamination_recall_at_full_budget(m):
    """Items of each length with as many edits as they may have, of each kind and mixed, in other text: at least 0.9 are found (0.85 of any one kind), and all that have none."""
    rng = random.Random(m)
    item = [f"w{rng.randrange(10**6)}" for _ in range(m)]
    items = decontaminate.Items([(1, " ".join(item)), (2, "another item of words that no text has")])
    hits = []
    for kind in range(5):
        docs = []
        for _ in range(60):
            d = list(item)
            for at in sorted(rng.sample(range(m), m // 5 if kind < 4 else 0), reverse=True):
                d[at : at + 1] = ([], [f"x{rng.randrange(10**6)}"], [d[at], f"y{rng.randrange(10**6)}"])[kind if kind < 3 else rng.randrange(3)]
            docs.append([f"a{rng.randrange(99)}" for _ in range(20)] + d + [f"b{rng.randrange(99)}" for _ in range(20)])
        raw = [" ".join(d).encode() for d in docs]
        got = decontaminate.search(items, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        hits.append(len({r for r, i, *_ in got if i == 0}) / 60)
    assert sum(hits[:4]) >= 3.6 and min(hits) >= 0.85 and hits[4] == 1, (m, hits)


def test_decontamination_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(3 + 4 * i))) for i in range(5)]
    docs = texts_of(spark, [(i, f"before {t} after", "s") for i, t in items])
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(i, i, 0) for i, _ in items}


def test_decontamination_odd_inputs(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "dup row here and there"), (4, "one")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(odd(spark), items).collect()} >= {4, 5, 6, 9}
    assert decontaminate.matches(odd(spark), items.limit(0)).count() == 0
    assert decontaminate.clean(empty(spark), items).count() == 0


def test_decontamination_keeps_rows_by_their_own_text(spark):
    """Null ids, repeated rows, one id with two texts, and columns of clashing names."""
    item = " ".join(f"w{j}" for j in range(12))
    rows = [(None, item), (None, "clean text"), (None, None), (1, "x " + item), (1, "other text"), (2, "same"), (2, "same")]
    docs = texts_of(spark, [(i, t, "s") for i, t in rows]).withColumn("item_id", F.lit(7)).withColumn("edits", F.array(F.lit("a")))
    got = decontaminate.clean(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, "clean text"), (None, None), (1, "other text"), (2, "same"), (2, "same")], key=str)


# --- pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} < before, name
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in kept.collect()]
            assert all(i == c for i, (n, c) in brute_components(rows, 5, 80).items() if n)
    assert decontaminate.matches(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) <= {r.doc_id for r in kept.collect()} and len(out)
    assert len(set(zip(out.shard, out.slot, strict=True))) == len(out)


def test_pipeline_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and an empty table pass through every stage."""
    import corpus_pipeline

    good = [t for t in pd.read_parquet(f"{SF}/documents.parquet").text if t and len(t.split()) > 80][:40]
    rows = [(None, good[0], "s"), (None, good[1], None), (None, None, "s"), (3, good[2], "s"), (3, good[2], "s"), (4, good[3] + " ", "t"), *((10 + i, t, f"s{i % 3}") for i, t in enumerate(good))]
    for name, table in (("some", rows), ("none", [])):
        sf = tmp_path / name
        texts_of(spark, table and [(i, t, s) for i, t, s in table]).write.parquet(str(sf / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(sf / f"{other}.parquet"))
        docs = spark.read.parquet(str(sf / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, str(sf)).persist()
            assert out.columns == docs.columns, stage
            if name == "none":
                assert out.count() == 0, stage
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(sf)).collect()
        assert len({(r.shard, r.slot) for r in last}) == len(last) == docs.count()
