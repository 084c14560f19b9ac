import hashlib
import random
import re
import textwrap
import time
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, licenses, minhash, secrets


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


# --- near duplicates --------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(n)
    both = Counter((a, b) for ns in where.values() for k, a in enumerate(ns) for b in ns[k + 1 :])
    links = [(sets[a][0], sets[b][0]) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n)]
    return groups({i for i, _ in sets}, links)


def changed(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "two one"), (6, "one two\x85"), (None, "one two"), (7, "a " * 5000), (8, "a " * 4000)]
    base = rng.choices(vocabulary, k=120)
    for i in range(40):  # a large group: all near one text, most far from each other
        rows.append((100 + i, " ".join(changed(base, rng, i % 5))))
    step = rng.choices(vocabulary, k=150)
    for i in range(12):  # a chain
        rows.append((220 - i, " ".join(step)))
        step = changed(step, rng, 2)
    shared = rng.choices(vocabulary, k=60)
    for i in range(25):  # a passage in common, no duplicates
        rows.append((300 + i, " ".join(rng.choices(vocabulary, k=25) + shared + rng.choices(vocabulary, k=25))))
    rows += [(400 + i, "exactly the same text in many rows here") for i in range(30)] + [(400, "exactly the same text in many rows here")]
    rows += [(500, rows[10][1]), (500, rows[55][1])]  # one id with two texts links their groups
    docs = spark.createDataFrame([(i, t, 0, True) for i, t in rows], "doc_id long, text string, component_id int, kept boolean")
    got = minhash.near_duplicates(docs).collect()
    want = plain_components(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), len(shingles(t)), str(want.get(i))) for i, t in rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def plain_super_minhash(elements, m):
    out = [2**32 - 1] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            draw = int(common.mixed(np.array([(e + 0xD1B54A32D192ED03 * (j + 1)) % 2**64 if j else e], dtype=np.uint64))[0])
            k = j + (draw & 0xFFFFFFFF) % (m - j)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 24 | draw >> 40)
    return out


def test_signatures_against_the_plain_algorithm():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 3, 7, 30, 200, 900)]
    got = minhash.super_minhash(sets, 20)
    for s, sig in zip(sets, got):
        assert sig.tolist() == plain_super_minhash(s.tolist(), 20)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = minhash.super_minhash([np.unique(x[:250]), np.unique(x[50:])])
        errors.append((a == b).mean() - 2 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1200)] + [(7, 7), (None, 3), (5, 4)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(220)]
    want = groups({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    for e in (frame, common.contracted(frame)):
        assert {r.node: r.component for r in common.components(e).collect()} == {x: c for x, c in want.items() if any(x in p and p[0] != p[1] and None not in p for p in edges)}
    assert common.components(frame.limit(0)).count() == 0


# --- decontamination --------------------------------------------------------


def plain_tiles(doc, test, least):
    used_d, used_t, out = set(), set(), []
    while True:
        best, found = least, []
        for t in range(len(test)):
            for d in range(len(doc)):
                n = 0
                while t + n < len(test) and d + n < len(doc) and doc[d + n] == test[t + n] and d + n not in used_d and t + n not in used_t:
                    n += 1
                if n > best or (n == best and not found):
                    best, found = n, []
                if n == best and n >= least:
                    found.append((d, t, n))
        for d, t, n in found:
            if not used_d & set(range(d, d + n)) and not used_t & set(range(t, t + n)):
                used_d |= set(range(d, d + n))
                used_t |= set(range(t, t + n))
                out.append((d, t, n))
        if not found:
            return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=14), st.integers(2, 4))
def test_tiles_against_the_plain_search(doc, test, least):
    got = decontamination.tiles(np.array(doc, dtype=np.uint64), np.array(test, dtype=np.uint64), least)
    assert sorted(got) == sorted(plain_tiles(doc, test, least))


def test_reordered_passages_are_found(spark):
    passage = "the first half of this question asks how many stones lie there while its second half says why nobody counted them"
    words = passage.split()
    swapped = " ".join(words[10:] + words[:10])
    docs = spark.createDataFrame([
        (1, f"intro text {passage} and more"), (2, "x " * 300 + swapped.upper() + "! " + "y " * 300), (3, " ".join(words[:9])), (4, None), (5, ""), (6, " ".join(reversed(words))),
        (None, passage), (1, f"intro text {passage} and more"), (7, "... tiny test ..."), (8, "tiny, TEST"), (9, "test tiny"),
    ], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'z' AS covered")
    benchmark = spark.createDataFrame([(10, passage), (11, None), (12, ""), (13, "tiny test"), (14, passage), (None, "ignored")], "item_id long, text string")
    for block_words in (5, 10**6):
        got = decontamination.matches(docs, benchmark, block_words=block_words).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(1, 10): 2, (1, 14): 2, (2, 10): 1, (2, 14): 1, (None, 10): 1, (None, 14): 1, (7, 13): 1, (8, 13): 1})
        assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    assert sorted(str(r.doc_id) for r in decontamination.clean(docs, benchmark).collect()) == ["3", "4", "5", "6", "9", "None"]
    assert decontamination.matches(docs, benchmark.limit(0)).count() == 0 and decontamination.clean(docs.limit(0), benchmark).count() == 0


def test_work_of_a_search_follows_the_words(monkeypatch):
    """A long text that shares a long passage is hashed a few times over, not once for every word of a run's length."""
    rng = np.random.default_rng(5)
    doc = rng.integers(1, 2**60, 20_000).astype(np.uint64)
    test = np.concatenate((doc[700:1000], doc[300:600]))
    worked = []
    monkeypatch.setattr(decontamination, "mixed", lambda x: worked.append(len(x)) or common.mixed(x))
    if hasattr(decontamination, "sums"):
        plain = decontamination.sums
        monkeypatch.setattr(decontamination, "sums", lambda h: worked.append(len(h)) or plain(h))
    assert sorted(decontamination.tiles(doc, test)) == [(300, 300, 300), (700, 0, 300)]
    assert sum(worked) < 10 * len(doc)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b.", "..", "(x)", "x", "é", "\x1c", "\0", "a\0", "abcdefgh", "abcdefghi", "Q" * 17, "q" * 17 + "!", "q" * 16 + "r", " ", "\t", "\r\n", "\x0b"]), max_size=20), max_size=6))
def test_words_of_many_texts_at_once(parts):
    texts = ["".join(p).encode() for p in parts]
    h, ends = decontamination.tokens(texts)
    want = [[bare for w in t.lower().split() if (bare := w.strip(b".,;:!?\"'()[]{}<>*"))] for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in want]
    assert len(set(zip(h.tolist(), sum(want, [])))) == len(set(h.tolist())) == len(set(sum(want, [])))


# --- licences ---------------------------------------------------------------


def plain_scan(text, threshold=licenses.THRESHOLD):
    text = text or ""
    found = []
    for unit in {*text.split("\n"), *re.split(r"\n\s*\n", text), text}:
        grams = set(licenses.template_bigrams(unit))
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                own = set(licenses.template_bigrams(t))
                if grams and 2 * len(grams & own) / (len(grams) + len(own)) >= threshold:
                    found.append((-2 * len(grams & own) / (len(grams) + len(own)), name))
    return len(found), sorted({n for _, n in found}), min(found)[1] if found else None, -min(found)[0] if found else None


def test_licences_against_plain_code(spark):
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][1]
    rng = random.Random(1)
    cut = mit.split()
    texts = [None, "", "\n\n", "Released under the MIT License.", "RELEASED under -- the MIT licence / license", mit, "code\n\n" + mit.replace(". ", ".\n") + "\n\nmore code\n" + apache, " ".join(w for w in cut if rng.random() > 0.06), " ".join(cut[:60]), "Licensed under CC BY-NC 4.0.\n" * 40, "word " * 20_000, "the MIT License"]
    texts += ["\n".join(rng.choice([licenses.TEMPLATES["GPL-3.0"][0], "plain prose that goes on", "This work is licensed"]) for _ in range(4)) for _ in range(6)]
    docs = spark.createDataFrame([(i % 15, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = licenses.license_scan(docs).collect()
    assert [(r.n_matches, r.licenses, r.best_license, r.best_dice) for r in got] == [plain_scan(t) for t in texts]
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_licences_in_paragraphs_and_within_lines(spark):
    breaks = {
        "MIT": ["The above copyright notice", 'THE SOFTWARE IS PROVIDED "AS IS"'],
        "Apache-2.0": ["You may obtain a copy", "http://www.apache.org", "Unless required by"],
        "GPL-3.0": ["This program is distributed", "You should have received"],
        "BSD-2-Clause": ["1. Redistributions", "2. Redistributions", "THIS SOFTWARE IS PROVIDED"],
    }
    code = "\n\n".join(f"def part_{i}(value):\n    total = value + {i}\n    return total, 'of the part number {i}'" for i in range(60))
    texts, names = [], []
    for name, at in breaks.items():
        text = licenses.TEMPLATES[name][1 if name != "BSD-2-Clause" else 0]
        for start in at:
            assert start in text
            text = text.replace(start, "\n\n" + start, 1)
        wrapped = "\n\n".join("\n".join(textwrap.wrap(x, 70)) for x in text.split("\n\n"))
        for form in (text, wrapped, "Copyright (c) 2020 A. Person\n\n" + wrapped):
            texts.append(f"{form}\n\n{code}")
            names.append(name)
        texts.append(f"{code}\n\n{wrapped}\n\n{code}")
        names.append(name)
    for line, name in [("This small library of many useful parts is Released under the MIT License and has been in use at many places for years", "MIT"), ("See the manual for all of the parts (Licensed under CC BY-NC 4.0.) and write to its authors about the rest of them", "CC-BY-NC-4.0")]:
        texts.append(f"{code}\n{line}\n{code}")
        names.append(name)
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.best_license) for r in got] == [([n], n) for n in names]
    # a wrapped notice may begin with a line that is the short one
    assert all(r.n_matches in (1, 2) and r.best_dice > 0.95 for r in got)
    assert licenses.license_scan(spark.createDataFrame([(1, code + "\n\n" + licenses.TEMPLATES["MIT"][1][:300] + "\n\n" + code)], "doc_id long, text string")).first().n_matches == 0


def test_long_texts_with_a_licence_line_cost_little_and_runs_stay(spark, monkeypatch):
    line, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][1]
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(20_000))
    start = time.monotonic()
    got = licenses.license_scan(spark.createDataFrame([(1, f"{long}\n{line}\n{long}")], "doc_id long, text string")).first()
    assert (got.n_matches, got.licenses) == (1, ["MIT"])
    assert time.monotonic() - start < 60  # words computed again for each pair took minutes
    parts = [line, apache, *re.split(r"(?<=\. )", apache), "Released under", "the MIT License.", "see \0 this", "Licensed under CC BY-NC 4.0.", "other words of a text"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\n\n", "\0"]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pruned = licenses.license_scan(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(licenses, "_has_room", lambda *_: F.lit(True))
    assert pruned == licenses.license_scan(docs).orderBy("doc_id").collect()


# --- secrets ----------------------------------------------------------------

KEY = "AKIA" + "ABCDEFGH12345678"


def plain_base(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdefgh", "x", "AKIA", "AKIA12", "ABCDEFGHIJKL", "0123456789abcdef", "ffff", "é😀", "\n", "-._/+"]), max_size=14).map("".join))
def test_plain_spans_against_plain_patterns(text):
    assert secrets.plain_spans(text) == plain_base(text)


def test_weak_parts_need_each_other(spark):
    texts = {
        0: "client_id = reader7 then nothing else",
        1: "client_id = reader7\nprivate_key = hunter22!",
        2: "private_key = hunter22!" + " far" * 100 + " client_id = reader7",
        3: f"{KEY} with wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE4 beside it",
        4: "only wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE4 here",
        5: "see https://db.example.org/x pwd=open",
        6: "see https://db.example.org/x and http://other.example.org",
        7: None,
        8: "",
        9: 'é😀 token = "a897a8e780f66393db9ad802d20916ca003aa542"',
        10: "login: bob pwd: swordfish " * 20_000,
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()] + [(0, texts[0], "s")], "doc_id long, text string, kinds string")
    got = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    kinds = {i: [x.split(":")[0] for x in r.spans.split(",") if x] for i, r in got.items()}
    assert kinds[0] == kinds[2] == kinds[4] == kinds[6] == kinds[7] == kinds[8] == []
    assert kinds[1] == ["part_id", "part_secret"] and kinds[3] == ["access", "part_secret"] and kinds[5] == ["part_endpoint", "part_secret"]
    assert len(kinds[10]) == 40_000 and (got[9].n_assign, got[9].n_access, got[9].n_hex) == (1, 0, 1)
    assert re.fullmatch(r"assign:3:\d+,hex:12:52", got[9].spans)
    for i, r in got.items():
        base = [(secrets.KINDS[k], s, e) for s, k, e in plain_base(texts[i] or "")]
        assert r.base_sha256 == secrets.digest_of(base) == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[3] == "[SECRET] with [SECRET] beside it" and clean[7] is None and clean[8] == "" and clean[0] == texts[0]
    assert secrets.redacted(docs).columns == docs.columns and secrets.secret_digest(docs.limit(0)).count() == 0


def test_blocks_of_a_bucket_lose_no_link(spark):
    rng = random.Random(8)
    base = rng.choices([f"v{i}" for i in range(300)], k=150)
    rows = [(i, " ".join(changed(base, rng, rng.randrange(14)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=16).collect()}
    assert got == plain_components(rows) and len(set(got.values())) > 10
