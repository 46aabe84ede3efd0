"""Operators that map over texts: pieces, pseudonyms, fertility, decontamination, quality."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination, pii_feistel, piece_lattice, quality_compression, quality_fertility, textkit

ODD = [None, "", " ", "\n\n", "a", "a b", "▁ <0x0A> 漢字 \t é", "x" * 30_000, "word " * 8_000, "\u0000 zero", "a b", "A B c. D e f g"]


# --- words ---------------------------------------------------------------------------------


def test_words_and_shingles_equal_a_regex():
    for kit, pattern in ((textkit.NOT_SPACE, "[^\x20\x09-\x0d]+"), (textkit.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        texts = [t or "" for t in ODD] + ["Ä-b_c 12 \x0b\x0cq"]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        w = textkit.Words([t.encode() for t in texts], kit)
        words = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
        assert words == [x for t in low for x in re.findall(pattern, t)]
        by = {}
        for word, h in zip(words, w.hash.tolist(), strict=True):
            assert by.setdefault(word, h) == h
        assert len(set(by.values())) == len(by)
    sizes = [len(h) for _, h in textkit.shingle_sets(["a b c a b c", "a b", "", None, "b a"], 3)]
    assert sizes == [3, 1, 0, 0, 1]


# --- 1: piece lattice ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return piece_lattice.Lattice(piece_lattice.Params())


def every_path(lattice, chunk):
    """Scores of all segmentations of a short chunk."""
    into = lattice.edges(chunk)
    paths = {0: [(0, ())]}
    for j in range(1, len(chunk) + 1):
        paths[j] = [(s + e[2], (*ids, e[1])) for e in into[j] for s, ids in paths[e[0]]]
    return sorted(paths[len(chunk)], key=lambda x: -x[0])


def test_nbest_equals_enumeration(lattice):
    rng = random.Random(5)
    for chunk in [" the", " Hello", " xx漢é", "zzzz", " enling", *(" " + "".join(rng.choices("aehnrt", k=7)) for _ in range(20))]:
        exact = every_path(lattice, chunk)
        got = lattice.nbest(chunk, 6)
        assert [s for s, _ in got] == [s for s, _ in exact[:6]]
        assert len({tuple(ids) for _, ids in got}) == len(got)
        lattice.solve({chunk})
        ids, score, gap = lattice.cache[chunk]
        assert score == exact[0][0] and (len(exact) == 1 or gap == exact[0][0] - exact[1][0])
        assert np.frombuffer(ids, np.int32).tolist() == got[0][1]


def test_text_alternatives_equal_sums_over_chunks(lattice):
    text = "the enling of er"
    made = lattice.encode(text)
    lists = [every_path(lattice, c) for c in lattice.chunks(" " + text)]
    sums = sorted((sum(s for s, _ in combo) for combo in itertools.product(*[x[:5] for x in lists])), reverse=True)
    assert [made["score"], *(a["score"] for a in made["alternatives"])] == sums[:4]
    for a in made["alternatives"]:
        assert lattice.decode(piece_lattice.apply_edits(made["ids"].tolist(), a["edits"])) == text


def test_library_agrees_on_the_best(lattice):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    p = piece_lattice.Params()
    with open(f"{p.tokenizers}/{p.model}", "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for x in proto.pieces:
        e = lattice.entries.get(x.piece.replace("▁", " "))
        if e and e[0] >= 0 and x.type == 1:
            x.score = e[1] / piece_lattice.SCALE
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("Stingou the er of and", "Eauouon enpaeux leaux", "no such words 漢"):
        assert lattice.encode(text)["ids"].tolist() == sp.encode(text)


def test_lockstep_equals_one_by_one(lattice, monkeypatch):
    words = {" " + "".join(random.Random(i).choices("aehnrté漢#", k=5)) for i in range(60)}
    a, b = piece_lattice.Lattice(piece_lattice.Params()), piece_lattice.Lattice(piece_lattice.Params())
    a.solve(words)
    monkeypatch.setattr(piece_lattice, "TOGETHER", 0)
    b.solve(words)
    assert a.cache == b.cache


def test_encoding_is_lossless_for_odd_texts(docs):
    made = piece_lattice.encode(docs(list(enumerate(ODD)))).orderBy("doc_id").collect()
    for r, t in zip(made, ODD, strict=True):
        assert r["lossless"] and r["n_pieces"] == len(r["ids"]) and r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert made[0]["n_pieces"] == 0 and made[0]["alternatives"] == []
    assert piece_lattice.encode(docs([])).count() == 0


# --- 3: pseudonyms -------------------------------------------------------------------------

CARD, OTHER = "4111111111111111", "4111111111111112"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_validity_and_links(docs):
    rows = [
        f"card {CARD} and 4111-1111-1111-1111, not {OTHER}.", "on 1999-02-28, 2/28/1999 and 28.02.1999; never 1999-02-30", "DE89 3704 0044 0532 0130 00 = DE89370400440532013000",
        "ip 161.17.88.162 v1.2.3.4.5", "+1 (017) 555-7713 or (017) 555-7713", "123-45-6789 but 666-12-1234", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "die.55@mail4.example.com", f"again {CARD}",
    ]
    got = texts(pii_feistel.pseudonymise(docs(list(enumerate(rows)))))
    card, dashed = re.match(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}), not " + OTHER, got[0]).groups()
    assert card != CARD and luhn(card) and dashed.replace("-", "") == card and got[8] == f"again {card}"
    iso, us, dot = re.match(r"on (\S+), (\S+) and (\S+); never 1999-02-30", got[1]).groups()
    y, m, d = map(int, iso.split("-"))
    assert iso != "1999-02-28" and us == f"{m}/{d:02d}/{y}" and dot == f"{d:02d}.{m:02d}.{y}"
    a, b = got[2].split(" = ")
    turned = "".join(str(int(c, 36)) for c in b[4:] + b[:4])
    assert a.replace(" ", "") == b and b[:2] == "DE" and b != rows[2].split(" = ")[1] and int(turned) % 97 == 1
    assert re.fullmatch(r"ip (\d+\.){3}\d+ v1\.2\.3\.4\.5", got[3]) and "161.17.88.162" not in got[3]
    p, q = re.fullmatch(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", got[4]).groups()
    assert p == q != "(017) 555-7713"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} but 666-12-1234", got[5]) and "123-45-6789" not in got[5]
    assert re.fullmatch(r'token = "[a-z0-9]{40}"', got[6]) and got[6] != rows[6]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@mail4\.example\.com", got[7]) and got[7] != rows[7]


def test_permutations_are_one_to_one_and_keyed(spark):
    sql = pii_feistel._Sql(pii_feistel.Params(key="k"))
    df = spark.range(17 * 101).select(F.expr(f"{sql.pair('t', 'id div 101', 'id % 101', 17, 101)}").alias("g"))
    assert df.select("g.a", "g.b").distinct().count() == 17 * 101
    df = spark.range(1000).select(F.expr(f"{sql.chars('t', 'lpad(cast(id as string), 3, chr(48))')}").alias("c"))
    assert df.distinct().count() == 1000 and df.filter("c rlike '^[0-9]{3}$'").count() == 1000
    other = pii_feistel._Sql(pii_feistel.Params(key="l"))
    a, b = (spark.range(50).select(F.expr(s.chars("t", "cast(id + 1000000 as string)"))).collect() for s in (sql, other))
    assert a != b


def feistel_chars(p, kind, text):
    """The same network in plain Python."""
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def shift(half, other, i):
        stream = "".join(hashlib.sha256(f"{p.key}|{kind}|{i}.{k}|{len(half)}|{other}".encode()).hexdigest() for k in range(len(half) // 32 + 1))
        out = ""
        for j, c in enumerate(half):
            al = next((x for x in pii_feistel.ALPHABETS if c in x), None)
            out += al[(al.index(c) + int(stream[2 * j : 2 * j + 2], 16)) % len(al)] if al else c
        return out

    for i in range(p.rounds):
        a, b = (shift(a, b, i), b) if i % 2 == 0 else (a, shift(b, a, i))
    return a + b


def test_network_equals_plain_python(docs):
    p = pii_feistel.Params(key="secret")
    value, local = "04dbebab91ab85687d33eeaaf9ac699e1188f962" * 2, "Mária.van_x-7"
    got = texts(pii_feistel.pseudonymise(docs([(1, f'token = "{value}"'), (2, f"{local}@ex.org")]), p))
    assert got == [f'token = "{feistel_chars(p, "secret", value)}"', f"{feistel_chars(p, 'email', local)}@ex.org"]


def pseudonym_brute(p, x):
    """(kind, pseudonym) of a candidate, or None, step by step."""
    import datetime

    import regex

    def pair(kind, a, b, ma, mb):
        draw = lambda i, other, m: int(hashlib.sha256(f"{p.key}|{kind}|{i}|{m}|{other}".encode()).hexdigest()[:15], 16) % m
        for i in range(p.rounds):
            a, b = ((a + draw(i, b, ma)) % ma, b) if i % 2 == 0 else (a, (b + draw(i, a, mb)) % mb)
        return a, b

    refill = lambda shape, new, keep: "".join(next(it) if c in keep else c for it in [iter(new)] for c in shape)
    kind = next(k for k, pattern in pii_feistel.PATTERNS.items() if regex.fullmatch(pattern, x))
    digits = re.sub("[^0-9]", "", x)
    if kind == "email":
        local = x.split("@")[0]
        return kind, feistel_chars(p, kind, local) + x[len(local) :]
    if kind == "secret":
        at = re.search("[\"']", x).end()
        return kind, x[:at] + feistel_chars(p, kind, x[at:-1]) + x[-1]
    if kind == "iban":
        plain, mod = x.replace(" ", ""), lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
        if mod(plain[4:] + plain[:4]) != 1:
            return None
        new = feistel_chars(p, kind, plain[4:])
        return kind, refill(x, plain[:2] + f"{98 - mod(new + plain[:2] + '00'):02d}" + new, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if kind == "ip":
        o = list(map(int, x.split(".")))
        a, b = pair(kind, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return kind, f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        parts = re.split("[-/.]", x)
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if "." in x else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            try:
                day = datetime.date(*(int(parts[k]) for k in order))
                break
            except ValueError:
                day = None
        if day is None or not 1900 <= day.year <= 2099:
            return None
        n, base = (day - datetime.date(1900, 1, 1)).days, datetime.date(1900, 1, 1)
        a, b = pair(kind, n // 4297, n % 4297, 17, 4297)
        new = base + datetime.timedelta(a * 4297 + b)
        if order[0] == 0:
            return kind, new.isoformat()
        own = {order[0]: f"{new.year:04d}", **{k: str(v) if len(parts[k]) == 1 else f"{v:02d}" for k, v in ((order[1], new.month), (order[2], new.day))}}
        return kind, re.search("[-/.]", x)[0].join(own[k] for k in range(3))
    if kind == "ssn":
        area, group, serial = map(int, x.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a, b = pair(kind, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        return kind, f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "phone":
        return (kind, refill(x, digits[: max(0, len(digits) - 10)] + feistel_chars(p, kind, digits[-10:]), "0123456789")) if 8 <= len(digits) <= 15 else None
    if not luhn(digits):
        return None
    new = feistel_chars(p, kind, digits[:-1]) + "0"
    total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(new))))
    return kind, refill(x, new[:-1] + str(-total % 10), "0123456789")


def test_whole_texts_equal_a_plain_computation(docs):
    import regex

    p, rng = pii_feistel.Params(key="other"), random.Random(6)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    card = lambda: next(x for x in iter(lambda: d(16), None) if luhn(x))

    def iban():
        body = rng.choice(["DE", "GB", "FR"]), d(10) + rng.choice(["", "AB"]) + d(8)
        check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        whole = f"{body[0]}{check:02d}{body[1]}"
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    makers = [
        lambda: f"{rng.choice(['a.b', 'Zoë_9', 'x+y'])}{d(2)}@ex{d(1)}.org", lambda: f"api_key: '{d(9)}abcXYZ_/{d(rng.choice([3, 300]))}'", iban, lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"{rng.randrange(1890, 2105)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d}", lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 31)}/{rng.randint(1900, 2099)}", lambda: f"{rng.randint(1, 31):02d}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.choice(['666', '000', d(3)])}-{d(2)}-{d(4)}", lambda: f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", card, lambda: "-".join(re.findall("....", card())), lambda: d(rng.randint(5, 25)), lambda: rng.choice(["word", "é", "\n", "1.2.3.4.5", "12-34"]),
    ]
    rows = [rng.choice([" ", ", ", "\n"]).join(rng.choice(makers)() for _ in range(rng.randint(1, 30))) for _ in range(120)]
    find = regex.compile("|".join(pii_feistel.PATTERNS.values()))
    got = {r["doc_id"]: r for r in pii_feistel.pseudonymise(docs(list(enumerate(rows))), p).collect()}
    kinds = Counter()
    for i, text in enumerate(rows):
        made = [(m, pseudonym_brute(p, m[0])) for m in find.finditer(text)]
        out, at = "", 0
        for m, new in made:
            out, at = out + text[at : m.start()] + (new[1] if new else m[0]), m.end()
        assert got[i]["text"] == out + text[at:]
        assert [(x["kind"], x["out"]) for x in got[i]["_pseudonyms"]] == [new for _, new in made if new]
        kinds.update(new[0] for _, new in made if new)
    assert set(kinds) == set(pii_feistel.PATTERNS) and min(kinds.values()) > 10


def test_pseudonyms_of_odd_texts(docs):
    rows = [*ODD, "9" * 50_000, "a@" * 5_000, "1." * 5_000, f"{CARD}{CARD}"]
    df = pii_feistel.pseudonymise(docs(list(enumerate(rows))))
    assert texts(df) == rows and df.columns[-1] == "_pseudonyms"
    assert not re.search("Python|Arrow", df._jdf.queryExecution().toString())


# --- 4: fertility --------------------------------------------------------------------------


def base_brute(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        dup += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again)


def test_base_figures_equal_brute_force():
    rows = [*ODD, "a b c\na b c\n \n \nx", "p q r p q r p q é# $$ é#", "A a A a A a"]
    got = quality_fertility.base_figures(rows)
    assert [tuple(g[c] for c in quality_fertility.COUNTS) for g in got] == [base_brute(t) for t in rows]


def test_bands_reject_what_leaves_the_usual_range(spark, docs, folder, query):
    rng = random.Random(1)
    words = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randint(1, 4))) for _ in range(400)]
    good = [(i, " ".join(rng.choices(words, k=120))) for i in range(80)]
    bad = [(1000, " ".join(f"{a}Ω☃{b}" for a, b in zip(rng.choices("qxzjk", k=90), rng.choices("QXZJK", k=90), strict=True))), (1001, "short"), (1002, None), (1003, "loop it now " * 40)]
    out = {r["doc_id"]: r for r in query("op4_tokeniser_fertility")(spark, folder(documents=docs(good + bad))).collect()}
    assert all(out[i]["kept"] for i, _ in good)
    assert not out[1000]["base_failed"] and not out[1000]["kept"] and out[1000]["left_bands"]
    assert all(out[i]["base_failed"] and not out[i]["kept"] for i in (1001, 1002, 1003))


def test_byte_fallback_is_what_the_piece_library_does():
    import sentencepiece

    p = quality_fertility.Params()
    v = quality_fertility.Vocabulary(f"{p.tokenizers}/{p.vocabulary}", f"{p.tokenizers}/{p.pieces}")
    model = sentencepiece.SentencePieceProcessor(model_file=f"{p.tokenizers}/{p.pieces}")
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abcé ßñ☃漢字кирぁ😀\u0301ﬁ\u1234") for _ in range(rng.randint(1, 30))).strip() or "x"
        in_bytes = sum(model.is_byte(i) for i in model.encode(text))
        spelt = [c for c in text if v.spelt[ord(c)] and not c.isspace()]
        assert in_bytes == sum(len(c.encode()) for c in spelt)
        assert abs(v.figures(text)[1] - len(spelt) / len("".join(text.split()))) < 1e-12


@pytest.mark.parametrize("min_docs", [3, 8, 1000])
def test_bands_equal_a_plain_computation(spark, min_docs):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("etaoinshr" if k else "\u1234\u1235abc", k=rng.randint(1, 9)))
    rows = [(i, " ".join(word(i % 17 > 0 or rng.random() < 0.7) for _ in range(rng.randint(40, 90))), rng.choice(["en", "de", "xx", None])) for i in range(60)] + [(99, None, "en"), (98, "", None)]
    p = quality_fertility.Params(min_docs=min_docs)
    figures = quality_fertility.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), p)
    got = {r["doc_id"]: r for r in quality_fertility.judge(figures, p).collect()}
    figs = {r["doc_id"]: r.asDict() for r in figures.collect()}
    failed = lambda f: f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
    usable = [f for f in figs.values() if not failed(f)]
    rejected = 0
    for f in figs.values():
        group = [u for u in usable if f["lang"] is not None and u["lang"] == f["lang"]]
        if len(group) < min_docs:
            group = [u for u in usable if u["script"] == f["script"]]
        if len(group) < min_docs:
            group = usable
        left = []
        for name, below, above, floor in p.bands:
            bins = sorted(int(u[name] * 1000 + 0.5) for u in group)
            q1, q2, q3 = (bins[-(-len(bins) * k // 4) - 1] / 1000 for k in (1, 2, 3))
            low, high = q2 - max(below * (q3 - q1), floor), q2 + max(above * (q3 - q1), floor)
            if not low <= f[name] <= high:
                left.append(name)
        r = got[f["doc_id"]]
        assert (r["base_failed"], r["kept"], r["left_bands"]) == (failed(f), not failed(f) and not left, ",".join(left))
        rejected += not failed(f) and bool(left)
    assert rejected and any("byte_share" in r["left_bands"] for r in got.values())
    assert quality_fertility.judge(figures.limit(0), p).count() == 0


# --- 5: decontamination --------------------------------------------------------------------


def hits_brute(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - 12)) if x else ():
            g = x[i : i + 13]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_hits_equal_brute_force(spark, docs, block_bytes):
    rng = random.Random(2)
    text = lambda n, v: " ".join(rng.choices(v, k=n))
    v, few = [f"w{i}" for i in range(300)], ["a", "b"]
    items = [(1, text(40, v)), (2, text(13, v)), (3, text(4, v)), (4, "Only!"), (5, None), (6, "..."), (7, text(30, few)), (8, "a " * 30), (None, text(20, v))]
    items += [(9, items[0][1])]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [text(60, v), text(20, v) + " " + items[0][1].upper() + " " + text(5, v), cut(items[0][1], 3, 16), cut(items[0][1], 3, 15), items[1][1] + "! " + items[2][1], "only", text(200, few), "a " * 500, items[8][1], *ODD]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.decontaminate(docs(list(enumerate(rows))), bench, ["doc_id"], decontamination.Params(block_bytes=block_bytes)).orderBy("doc_id").collect()
    for r, t in zip(got, rows, strict=True):
        assert (r["_words"], sum(x["last"] - x["first"] for x in r["_runs"]), list(r["_items"])) == hits_brute(t, items)


def test_stage_drops_contaminated_and_cuts_the_rest(spark, docs, folder):
    item = " ".join(f"Q{i}" for i in range(15))
    long = " ".join(f"é{i}" for i in range(400))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    d = docs([(1, item), (2, f"{long} {item}. {long}"), (3, long), (4, None)])
    got = {r["doc_id"]: r for r in decontamination.drop_contaminated(spark, d, folder(benchmark=bench)).collect()}
    assert set(got) == {2, 3, 4} and got[2]["text"] == f"{long} . {long}" and got[3]["text"] == long and got[4]["text"] is None
    assert got[3]["n"] == 7
    empty = decontamination.decontaminate(d, bench.limit(0), ["doc_id"]).collect()
    assert len(empty) == 4 and all(not r["_runs"] for r in empty)


# --- 10: quality ---------------------------------------------------------------------------


def test_classifier_learns_only_from_its_rows_and_holds_out_well(spark, docs, folder, query):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["the", "ering", "of", "thand", "onthe", "rest", "ation"], k=80))
    bad = lambda: " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in good().split())
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    labels = [(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2, 0) for i in range(300)]  # held-out labels lie
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 0)], "doc_id bigint, quality int, toxic int")
    path = folder(documents=docs([*rows, (400, None), (401, "")]), labels=lab)
    out = {r["doc_id"]: r for r in query("op10_quality_compression")(spark, path).collect()}
    assert len(out) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [r for i, r in out.items() if i < 300 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) > 0.95 * len(held)
    assert out[400]["score"] == out[401]["score"]
    kept = quality_compression.keep_quality(spark, docs(rows), path)
    assert kept.columns == docs([]).columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if out[i]["predicted"]}


def test_scores_equal_a_plain_computation(spark, docs, folder, query):
    import math

    import numpy as np
    import zstandard

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = [(i, " ".join(word() + (rng.choice(["!!", "|"]) if i % 4 == 0 else "") for _ in range(rng.randint(1, 150)))) for i in range(120)] + [(500, None), (501, "é" * 3000)]
    lab = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    path = folder(documents=docs(rows), labels=lab)
    p = quality_compression.Params()
    train, share = quality_compression.sample(spark.read.parquet(f"{path}/documents.parquet"), lab, p)
    texts = dict(rows)
    known = {i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(t for t, _ in train) == sorted(texts[i] for i in known) and share == sum(i % 4 > 0 for i in known) / len(known)
    halves = {k: [t for t, label in train if label == k] for k in (0, 1)}
    packers = []
    for k in (1, 0):
        own = [t.encode() for t in halves[k][0::2]]
        each = max(64, 65_536 // len(own) - 1)
        content = b"\n".join(x if len(x) <= each else x[(len(x) - each) // 2 : (len(x) - each) // 2 + each] for x in own)[:65_536]
        packers.append(lambda x, c=content: len(zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(x)))

    def features(text):
        raw = (text or "").encode()
        parts = [raw[i : i + 256] for i in range(0, len(raw), 256)] or [b""]
        g, b = (sum(map(f, parts)) for f in packers)
        return [(b - g) / (b + g), (b - g) / (b + g) * abs((b - g) / (b + g)), (b - g) / (len(raw) + 16)]

    x = np.array([features(t) for k in (0, 1) for t in halves[k][1::2]])
    y = np.repeat([0.0, 1.0], [len(halves[k][1::2]) for k in (0, 1)])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x1 = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    weight, w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(4)
    for _ in range(20_000):  # plain descent on the convex loss
        w -= (x1.T @ (weight * (1 / (1 + np.exp(-x1 @ w)) - y)) + 1e-3 * len(y) * np.array([0, *w[1:]])) / (0.25 * weight.sum() * 4)
    out = {r["doc_id"]: r["score"] for r in query("op10_quality_compression")(spark, path).collect()}
    for i, t in rows:
        n = len((t or "").encode())
        own = w[0] + ((np.array(features(t)) - mean) / scale) @ w[1:]
        z = (n * own + 128 * math.log(share / (1 - share))) / (n + 128)
        assert abs(out[i] - 1 / (1 + math.exp(-z))) < 1e-3


def test_classifier_without_labels(spark, docs, folder, query):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = query("op10_quality_compression")(spark, folder(documents=docs([(1, "x"), (1, "x")]), labels=lab)).collect()
    assert [r["score"] for r in out] == [0.5, 0.5]
