"""Operators over pairs, archives, pages, conversations, and the pipeline."""

import base64
import hashlib
import html
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import components, decontamination, frequency, ngram_jaccard, paragraph_minhash, piece_lattice, reply_trees, set_join, textkit, warc_zstd, wrapper_induction

ODD = [None, "", " ", "one", "two words", "é" * 20_000, "same same " * 4_000]


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def near_copies(seed, n_groups=6, size=8, words=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for k in range(size):
            t = base[:]
            for _ in range(k // 2):
                t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(t))
    return out


# --- components ----------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: u.find(x) for x in u}
    assert components.components(spark.createDataFrame([], "u int, v int")).count() == 0


# --- 6: n-gram Jaccard join ------------------------------------------------------------------


def jaccard_brute(pairs):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for i, t in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets.append((i, set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()))
    u = Union()
    for k, (i, a) in enumerate(sets):
        u.find(i)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                u.join(i, j)
    return sorted((i, len(s), u.find(i)) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_all_pairs(spark, docs, folder, query, seed):
    texts = [*ODD, *ODD, *near_copies(seed), "A B c d", "a b C D", "a b c d e"]
    texts += [" ".join(texts[20].split()[:40]) + " " + t for t in ("x y", "y x", "z")]
    pairs = [(3 * i + 5, t) for i, t in enumerate(texts)]
    got = query("op6_ngram_jaccard")(spark, folder(documents=docs(pairs))).collect()
    assert sorted(map(tuple, got)) == jaccard_brute(pairs)


def test_jaccard_is_the_same_without_rounds_and_with_rounds_throughout(docs):
    pairs = list(enumerate(near_copies(4)))
    for p in (ngram_jaccard.Params(rounds=0, fragments=3), ngram_jaccard.Params(linear=0, classes=(1, 3, 5), size=16)):
        assert sorted(map(tuple, ngram_jaccard.groups(docs(pairs), p).collect())) == jaccard_brute(pairs)


def test_jaccard_of_empty_and_null_tables_and_the_stage(spark, docs):
    assert ngram_jaccard.groups(docs([])).count() == 0
    assert sorted(ngram_jaccard.groups(docs([(2, None), (1, None)])).collect()) == [(1, 0, 1), (2, 0, 2)]
    t = " ".join(map(str, range(30)))
    kept = ngram_jaccard.keep_one(spark, docs([(4, t), (2, t), (2, t), (9, "other"), (7, None), (None, "free")]), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.filter("text is not null").collect()) == [(0, "free"), (2, t), (9, "other")]
    assert kept.count() == 4 and kept.columns == docs([]).columns


def test_elements_of_the_very_same_nodes_are_one_place_at_the_first(spark):
    lists = [(1, 4, [5, 7, 9, 11]), (2, 3, [7, 9, 11]), (3, 2, [11, 13]), (4, 1, [13])]
    nodes = spark.createDataFrame(lists, "node bigint, n bigint, prefix array<bigint>")

    def keys(column):
        yield column.flatten().to_numpy().view(np.uint64)

    common = spark.sparkContext.broadcast(frequency.frequent(nodes, ["prefix"], keys, (1,), 16))
    got = ngram_jaccard.shared_places(nodes, "prefix", common).select("key", "node", "n", "i", "c", "m").collect()
    assert sorted(map(tuple, got)) == [(7, 1, 4, 2, 2, 2), (7, 2, 3, 1, 2, 2), (11, 1, 4, 4, 3, 1), (11, 2, 3, 3, 3, 1), (11, 3, 2, 1, 3, 1), (13, 3, 2, 2, 2, 1), (13, 4, 1, 1, 2, 1)]


@pytest.mark.parametrize(("m", "rounds"), [(1, []), (100, [30])])
def test_rounds_count_a_key_as_often_as_it_stands_for_others(spark, monkeypatch, m, rounds):
    # sizes too far apart for any candidate
    rows = [(0, k, 2**k, 1, 30, m) for k in range(30)] + [(k, 100 * k + j, 10 + 990 * j, 1, 2, 1) for k in range(1, 1001) for j in range(2)]
    places = spark.createDataFrame(rows, "key bigint, node bigint, n bigint, i bigint, c bigint, m bigint")
    nodes = places.select("node", F.lit(b"").alias("sig"), F.lit(0).cast("long").alias("th"), F.lit(1).alias("size"), F.lit(0).cast("long").alias("b0"))
    made = []
    monkeypatch.setattr(set_join._Join, "round", lambda self, known: made.append(known.count()))
    assert set_join.linked(places, nodes, lambda needed: None, ngram_jaccard.Params()).count() == 0
    assert made == rounds


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 120).astype(np.uint64) * np.uint64(2654435761)) for _ in range(2))
        both = set_join.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = sum(int(x).bit_count() for x in (both[0] ^ both[1]).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


# --- 8: paragraphs -----------------------------------------------------------------------------


def paragraphs_brute(text, p):
    """(start, end, shingles) of every paragraph, window by window."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return []
    h = textkit.Words([text.encode()], textkit.NOT_SPACE).hash
    ends = [bool(re.search("[.!?][\"')\\]]?$", w)) for _, _, w in words]
    key = [(not e, int(textkit.mix(h[k : k + 1] + np.uint64(7))[0] >> np.uint64(1))) for k, e in enumerate(ends)]
    cuts = {len(words)}
    for k in range(len(words) - p.window + 1):
        least = min(key[k : k + p.window])
        cuts |= {j + 1 for j in range(k, k + p.window) if key[j] == least}
    out, start, at = [], 0, 0
    for c in sorted(cuts):
        if c - at >= p.min_words or c == len(words):
            if c - start >= p.min_words:
                own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, _, w in words[start:c]]
                out.append((words[start][0], words[c - 1][1], {tuple(own[j : j + 5]) for j in range(len(own) - 4)}))
            start = c
        at = c
    return out


def test_repeated_paragraphs_equal_all_pairs(spark, docs, folder, query):
    rng, p = random.Random(7), paragraph_minhash.Params()
    near = near_copies(8, n_groups=4, size=6, words=55)
    long, own = ([f"z{rng.randrange(10**6)}" for _ in range(k)] for k in (40, 9))
    dots = [" ".join(w + "." if rng.random() < 0.1 else w for w in t.split()) for t in near]
    pairs = [(i, f"intro {i}\n{t}\nshort line\n" + (near[0] if i % 5 == 0 else f"own {rng.random()}")) for i, t in enumerate(dots)]
    pairs += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, near[3] + "\n" + near[3]), (201, " ".join(long)), *[(201, f"{' '.join(own)}. {' '.join(long[:39])}")] * 2, (None, near[4])]
    sentences = [[f"s{rng.randrange(10**6)}" for _ in range(18)] for _ in range(4)]
    pairs += [(300 + k, " ".join(f"{['Some', 'Other'][k]} {' '.join(x)}." for x in sentences)) for k in range(2)]
    places = sorted({(i is None, i, s, e, frozenset(x)) for i, t in pairs for s, e, x in paragraphs_brute(t, p)}, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    u = Union()
    for x, (*_, a) in enumerate(places):
        u.find(x)
        for y, (*_, b) in enumerate(places[:x]):
            if 100 * len(a & b) >= 80 * len(a | b):
                u.join(x, y)
    expected = [(i, s, e, places[u.find(x)][1], places[u.find(x)][2]) for x, (_, i, s, e, _) in enumerate(places) if u.find(x) != x]
    d = docs(pairs)
    got = query("op8_paragraph_minhash")(spark, folder(documents=d))
    assert sorted(map(str, ((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in got.collect()))) == sorted(map(str, expected))
    assert len(expected) > 25 and sum(places[u.find(x)][4] != a for x, (*_, a) in enumerate(places)) > 2
    left = paragraph_minhash.remove(d, got)
    assert left.count() == len(pairs) and left.columns == d.columns
    assert paragraph_minhash.repeats(docs([])).count() == 0


def test_bands_have_the_recall_they_are_tuned_for():
    p = paragraph_minhash.Params()
    assert 1 - (1 - (p.least / p.per) ** p.rows) ** p.bands > 0.9998
    rng, met = random.Random(3), 0
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(19)]  # one word more at the end: 15 of 16 shingles
        one, two = (paragraph_minhash.Paragraphs([" ".join(t).encode()], paragraph_minhash.Params(window=99)) for t in (base, [*base, "x", "y", "z"]))
        met += bool((one.keys(p) == two.keys(p)).any())
    assert met >= 296


# --- 9: archives -------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, digest int, revisit string")


def test_archives_read_back_what_was_written(spark, folder, query):
    rows = [(5, "http://a/", "<p>x</p>"), (2, "http://b/ c\r\nX: y", "<p>x</p>"), (9, None, None), (4, "u", ""), (7, "u", "é" * 100_000), (7, "u", "é" * 100_000), (8, "u", "é" * 100_000), *((100 + i, f"http://h/{i}", f"<html>page {i % 50} of many</html>") for i in range(120))]
    got = query("op9_warc_zstd")(spark, folder(pages=pages_of(spark, rows))).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[h or ""]
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    whole = warc_zstd.read_archives(warc_zstd.write_archives(pages_of(spark, rows), warc_zstd.Params(least_revisit=9))).collect()
    assert sorted(bytes(r["payload"]) for r in whole if r["record_type"] == "response" and r["page_id"] in (2, 5, 4, 9)) == [b"", b"", b"<p>x</p>", b"<p>x</p>"]
    assert warc_zstd.read_archives(warc_zstd.write_archives(pages_of(spark, []))).count() == 0


def test_reader_uses_the_dictionary_and_reports_damage(spark):
    p = warc_zstd.Params()
    records = [warc_zstd.record(i, "http://h/", b"<html>some common page text " + str(i).encode() * 30, None, False, p) for i in range(300)]
    data = warc_zstd.pack(records, p)
    assert struct.unpack("<I", data[:4])[0] == warc_zstd.DICT_MAGIC
    assert list(warc_zstd.frames(data)) == records
    assert len(data) < len(b"".join(zstandard.compress(r) for r in records))
    size = struct.unpack("<I", data[4:8])[0]
    flipped = bytearray(data)
    flipped[size // 2] ^= 0xFF
    huge = zstandard.ZstdCompressor(level=1).compress(b"\0" * (80 << 20))
    bombs = [struct.pack("<II", warc_zstd.DICT_MAGIC, len(huge)) + huge, zstandard.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" + b"\0" * (300 << 20)), zstandard.compress(b"x" * (300 << 20))]
    damaged = [data[:-3], data + b"zz", data + b"\0" * 20, data[:20] + data[40:], bytes(flipped), data[:size // 2], struct.pack("<II", warc_zstd.DICT_MAGIC, 5) + b"hello", *bombs]
    for bad in damaged:
        with pytest.raises(warc_zstd.Broken):
            list(warc_zstd.frames(bad))
    read = warc_zstd.read_archives(spark.createDataFrame([(f"a{i}", bytearray(bad)) for i, bad in enumerate(damaged)], "archive string, content binary")).collect()
    assert {r["archive"] for r in read if r["error"]} == {f"a{i}" for i in range(len(damaged))}
    one = records[0]
    for bad in (one[:-1], one.replace(b"WARC/1.1", b"HTTP/1.1"), one.replace(b"WARC-Date", b"WARC-Day"), one.replace(b"common", b"cammon"), one.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)):
        with pytest.raises(warc_zstd.Broken):
            warc_zstd.parse(bad)
    assert warc_zstd.parse(one)["bytes"] == len(warc_zstd.parse(one)["payload"])


# --- 7: pages ----------------------------------------------------------------------------------


def page(i, host, body):
    nav = "".join(f'<li><a href="/{i}{k}">link {i} {k}</a></li>' for k in range(5))
    return f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">buy {i}!</div>{body}<div class="comments"><p>reader {i}: nice</p></div><footer>&copy; {host} {i}</footer></body></html>'


def test_articles_come_out_whole_and_alone(spark, folder, query):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(60):
        host = f"h{0 if i % 3 else i % 7}.example"
        parts = [" ".join(rng.choices(["alpha", "beta &amp; gamma", "de<b>l</b>ta", "x &lt; y"], k=rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        body = f"<h1>Title\n {i}</h1>" + "".join(f"<p>{p}" + ("</p>" if rng.random() < 0.7 else "<br>") for p in parts)
        tag = "article" if i % 2 else 'div class="post-content"'
        rows.append((i, f"http://{host}/{i}", page(i, host, f"<{tag}>{body}</{tag.split()[0]}>")))
        plain = [html.unescape(re.sub("</?b>", "", p)) for p in (f"Title {i}", *parts)]
        expected[i] = " ".join(" ".join(p.split()) for p in plain)
    rows += [(900, "http://x/", None), (901, None, ""), (902, "http://y/", "<p>cut off <b>he"), (903, "http://z/", "<div>" * 3000 + "deep"), (904, "bad", "no markup < here"), (905, "http://q/", "<nav>only menu</nav>")]
    expected |= {900: "", 901: "", 902: "cut off he", 903: "deep", 904: "no markup < here", 905: ""}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in query("op7_wrapper_induction")(spark, folder(pages=pages_of(spark, rows))).collect()}
    assert got == {i: (t, len(t)) for i, t in expected.items()}


def test_constant_texts_of_a_host_are_template(spark):
    body = lambda i: f"<div><p>Follow our channel for more</p><div><h1>N{i}</h1><p>{'story ' * (i + 3)}{i}</p></div><p>All rights kept</p></div>"
    rows = [(i, "http://t.example/", f"<body>{body(i)}</body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper_induction.main_text(pages_of(spark, rows)).collect()}
    assert got == {i: f"N{i} {'story ' * (i + 3)}{i}" for i in range(12)}
    joined = wrapper_induction.main_text(pages_of(spark, rows), wrapper_induction.Params(broadcast_bytes=0))
    assert {r["page_id"]: r["text"] for r in joined.collect()} == got


def matching_brute(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + matching_brute(x, y))
    return best[-1][-1] + 1


@pytest.mark.parametrize("cells", [1 << 22, 4])
def test_tree_matching_is_the_largest_ordered_one(monkeypatch, cells):
    monkeypatch.setattr(wrapper_induction.Match, "CELLS", cells)
    rng = random.Random(12)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["<p>x</p>", '<p class="a">y</p>', "<hr>"])
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 5))) + f"</{tag}>"

    for _ in range(150):
        a, b = (wrapper_induction.parse("".join(tree(3) for _ in range(rng.randint(1, 5)))) for _ in range(2))
        pairs = []
        assert wrapper_induction.match(a, b, pairs) == len(pairs) == matching_brute(a, b)
        places = sorted((x.index, y.index) for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:], strict=False))
        assert all(x.label == y.label for x, y in pairs)


def test_hostile_markup_takes_linear_time_and_heads_need_no_end(spark):
    import time

    began = time.perf_counter()
    for page in ('<x "' * 50_000, '<a b="' * 50_000, "<!" * 50_000, "<div " * 50_000, "<a b='x" * 50_001, "<svg" * 50_000, "<div>" * 50_000):
        wrapper_induction.layout(page, 3)
        wrapper_induction.extract(wrapper_induction.parse(page), [], [], wrapper_induction.Params())
    assert time.perf_counter() - began < 30
    rows = [(1, "http://x/", "<html><head><title>t</title><meta charset=utf-8><body><p>no end of head</p>"), (2, "http://y/", '<head><style>x</style></head><p title=">">one &lt; two</p>'), (3, "http://z/", "<p>before</p><p a='open>rest"), (4, "http://w/", "<head><title>a</title><body><p>text</p><script>'</head>'</script>")]
    got = {r["page_id"]: r["text"] for r in wrapper_induction.main_text(pages_of(spark, rows)).collect()}
    assert got == {1: "no end of head", 2: "one < two", 3: "before", 4: "text"}
    assert wrapper_induction.main_text(pages_of(spark, [])).count() == 0


def test_induction_needs_no_names_and_every_layout_has_its_own(spark):
    rng = random.Random(13)
    text = lambda k: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=k))
    rows, expected = [], {}
    for i in range(60):
        story = [f"T{i}", text(60), text(70)]
        menu = "".join(f'<p>{text(2)} {i}</p>' for _ in range(4))
        body = f'<div class="k1">{menu}</div><div class="k2"><h1>{story[0]}</h1><p>{story[1]}</p><p>Follow our channel for more</p><p>{story[2]}</p></div><div class="k3"><p>{text(9)}</p></div>'
        if i % 3 == 0:  # another layout of the same host, larger than 64 KB
            body = f'<section class="q{i}"><div class="menu content"><p>{text(3)}</p></div><div class="k9"><!--{"x" * 70_000}--><p>{story[0]} {story[1]}</p><p>Write to us today</p></div></section>'
            story = [f"{story[0]} {story[1]}"]
        rows.append((i, f"http://one.example/{i}", f"<body>{body}</body>"))
        expected[i] = " ".join(story)
    pages = pages_of(spark, rows)
    got = {r["page_id"]: r["text"] for r in wrapper_induction.main_text(pages).collect()}
    assert got == expected
    alone = {i: wrapper_induction.extract(wrapper_induction.parse(h), [], [], wrapper_induction.Params()) for i, _, h in rows}
    assert all(alone[i] != expected[i] for i in expected)
    joined = wrapper_induction.main_text(pages, wrapper_induction.Params(broadcast_bytes=0))
    assert {r["page_id"]: r["text"] for r in joined.collect()} == expected


# --- 2: reply trees ------------------------------------------------------------------------------


def test_formatting_is_reversible_and_marks_are_unique():
    rng = random.Random(4)
    bits = [*reply_trees.CONTROLS, "\\", "<", "s>", "/", "[", "INST]", "|", "role", "a", "\n", "é", "<|", "|>"]
    for _ in range(300):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 4))), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]
        text, mask = reply_trees.format_turns(turns, reply_trees.Params(loss_roles=tuple(r for r, _ in turns[:1])))
        assert reply_trees.read_turns(text) == turns
        assert text.count("<|end|>") == len(turns) and text.count("</s>") == 1 and "[INST]" not in text
        assert [reply_trees.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == (turns[0][0] if turns else None)]


def test_best_branches_of_a_tree(spark):
    kind = "conv_id long, node long, parent long, role string, text string, score double"
    rows = [(1, 0, None, "user", "a", None), (1, 1, 0, "assistant", "b", 1.0), (1, 2, 0, "assistant", "c", 2.0), (1, 3, 2, "user", "d", 0.5), (1, 4, 3, "assistant", "e", 0.1), (1, 5, 3, "assistant", "f", 0.2), (2, 10, 99, "user", None, 0.0), (3, 20, 21, "u", "cycle", 0.0), (3, 21, 20, "u", "cycle", 0.0)]
    rows += [(4, 1000 + i, 999 + i if i else None, "user", f"t{i}", 0.0) for i in range(300)]
    p = reply_trees.Params(branches=2)
    turns = reply_trees.paths(spark.createDataFrame(rows, kind), p)
    texts = {}
    for r in reply_trees.format_paths(turns, p).collect():
        texts[r["conv_id"], r["leaf"]] = [t for _, t in reply_trees.read_turns(r["formatted"])]
    assert texts == {(1, 5): ["a", "c", "d", "f"], (1, 4): ["a", "c", "d", "e"], (2, 10): [""], (4, 1299): [f"t{i}" for i in range(300)]}
    assert {(r["leaf"], r["rank"]) for r in turns.filter("conv_id = 1").collect()} == {(5, 1), (4, 2)}


def test_plain_conversations_read_back(spark, folder, query):
    rows = [(1, 0, "user", "hi</s>"), (1, 2, "assistant", "yo"), (1, 1, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 3, "user", "lost"), *((3, i, "user", f"{i}") for i in range(200))]
    c = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int")
    got = {r["conv_id"]: r for r in query("op2_reply_trees")(spark, folder(conversations=c)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", reply_trees.PROBE), (-1, 1, "assistant", reply_trees.PROBE)]:
        by[conv].append((turn, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for _, a, t in turns)), len(loss), sha(loss))


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_equals_its_steps_by_hand(spark, docs, folder):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "ering", "of", "thand", "onthe", "rest", "ation", "wher"]) + rng.choice(["", "an", "st", "ly"])
    good = lambda n=90: " ".join(word() for _ in range(n))
    rows = [(i, good() if i % 3 else " ".join(w + "%%%" for w in good().split())) for i in range(150)]
    item = " ".join(f"question{i}" for i in range(20))
    base = good(120)
    rows += [(500, base), (501, base), (502, base + " end"), (503, good(40) + " " + item), (504, f"{good()} reach jan.doe7@example.org or 4111111111111111 ok"), (505, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    path = folder(documents=docs(rows), labels=labels, benchmark=bench)
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, path)
        now = spark.createDataFrame(made.collect(), made.schema)
        seen.append((name, {r["doc_id"] for r in now.collect()}, now))
    (_, q, _), (_, j, _), (_, w, clean), (_, f, hidden), (_, e, coded) = seen
    assert all(len(a[2].columns) == len(docs([]).columns) for a in seen[:-1])
    assert not {i for i in range(150) if i % 3 == 0} & q and {500, 501, 502, 503, 504} <= q
    assert {500, 501, 502} & j == {500} and 503 in j and 503 not in w and {500, 504} <= w == f == e
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert "jan.doe7" not in texts[504] and "4111111111111111" not in texts[504] and texts[500] == base
    lattice = piece_lattice.Lattice(piece_lattice.Params())
    whole = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in whole} == e
    for r in whole:
        assert r["lossless"] and lattice.decode(r["ids"]) == (texts[r["doc_id"]] or "")
    assert decontamination.Params().share == 20 and clean.filter(F.col("text").contains("question3")).count() == 0
    assert coded.count() == len(whole)


def test_the_pipeline_drops_copies_of_five_word_jaccard_over_080(spark, docs):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    copy = base[:]
    for k in (30, 80, 130, 180):
        copy[k] = f"changed{k}"
    a, b = ({tuple(t[j : j + 5]) for j in range(196)} for t in (base, copy))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    a, b = ({tuple(t[j : j + 3]) for j in range(198)} for t in (base, copy))
    assert len(a & b) / len(a | b) < 0.9
    far = base[:]
    for k in range(10, 200, 20):
        far[k] = f"far{k}"
    rows = docs([(3, " ".join(copy)), (1, " ".join(base)), (5, " ".join(far))])
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    assert {r["doc_id"] for r in stage(spark, rows, "").collect()} == {1, 5}
    assert {r["component_id"] for r in ngram_jaccard.groups(rows).collect()} == {1, 3, 5}


def test_passages_that_begin_and_end_inside_lines_are_found_and_cut_out(docs):
    rng = random.Random(5)
    new = lambda k: [f"n{rng.randrange(10**9)}" + rng.choice(["", "", "", "", "."]) for _ in range(k)]
    wrap = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    pairs, whole = [], {}
    for k in range(60):
        passage, own = new(51 + k % 30), [new(40), new(40), new(30), new(30)]
        pairs += [(2 * k, wrap(own[0] + passage + own[1], 9)), (2 * k + 1, f"é {' '.join(own[2])} {' '.join(passage)} {' '.join(own[3])}")]
        whole[2 * k + 1] = (["é", *own[2]], passage, own[3])
    pairs.append((999, "loop " * 300))
    d = docs(pairs)
    rows = d.sparkSession.createDataFrame((made := paragraph_minhash.repeats(d)).collect(), made.schema)
    got = rows.collect()
    assert all(r["kept_doc_id"] == r["doc_id"] - 1 and r["doc_id"] % 2 for r in got if r["doc_id"] != 999)
    found = {r["doc_id"] for r in got} - {999}
    assert len(found) >= 57
    left = {r["doc_id"]: r["text"].split() for r in paragraph_minhash.remove(d, rows).collect()}
    for i, (before, passage, after) in whole.items():
        # words next to a passage go only as less than a fifth of a paragraph
        assert left[i][: len(before) - 5] == before[:-5] and left[i][len(left[i]) - len(after) + 5 :] == after[5:]
        assert len(left[i]) < len(before + passage + after) if i in found else left[i] == before + passage + after
    assert all(left[i] == t.split() for i, t in pairs if i % 2 == 0)


def test_copies_are_no_template_and_other_text_at_a_constant_place_stays(spark):
    copy = "<body><article><h1>One title</h1><p>The same article at many addresses</p></article></body>"
    rows = [(i, f"http://copies.example/{i}", copy) for i in range(6)]
    own = lambda i: "Real words of this page" if i == 11 else "All rights kept"
    rows += [(100 + i, "http://t.example/", f"<body><article><h1>N{i}</h1><p>{'story ' * (i + 3)}{i}</p><p>{own(i)}</p></article></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper_induction.main_text(pages_of(spark, rows)).collect()}
    assert {got[i] for i in range(6)} == {"One title The same article at many addresses"}
    assert all(got[100 + i] == f"N{i} {'story ' * (i + 3)}{i}" + (" Real words of this page" if i == 11 else "") for i in range(12))


def test_empty_tables_and_null_columns_everywhere(spark, docs, folder, query):
    conversations = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, n int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    path = folder(documents=docs([]), conversations=conversations, labels=labels, benchmark=bench, pages=pages_of(spark, []))
    rows = {n: query(n)(spark, path).count() for n in ("op1_piece_lattice", "op2_reply_trees", "op3_pii_feistel", "op4_tokeniser_fertility", "op5_winnowing", "op6_ngram_jaccard", "op7_wrapper_induction", "op8_paragraph_minhash", "op9_warc_zstd", "op10_quality_compression")}
    assert rows.pop("op2_reply_trees") == 1 and set(rows.values()) == {0}
    assert corpus_pipeline.run(spark, path).count() == 0


def test_the_stage_judges_rows_that_share_an_id_by_their_texts(spark, docs):
    words = [f"w{i}" for i in range(200)]
    near = [w if i != 50 else "other" for i, w in enumerate(words)]
    rows = [(4, " ".join(words)), (4, " ".join(near)), (4, "a text of its own"), (9, " ".join(near)), (None, " ".join(words)), (4, "a text of its own")]
    kept = ngram_jaccard.keep_one(spark, docs(rows), "").collect()
    assert [r["doc_id"] for r in kept] == [4, 4]
    assert {r["text"] for r in kept} in ({"a text of its own", t} for _, t in rows[:2])
