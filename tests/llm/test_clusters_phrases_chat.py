"""Centroid clustering, phrase mining and chat formatting against plain brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwell.llm import chat_format, chat_template, delta_lloyd, phrases

# --- Centroids ---------------------------------------------------------------


def lloyd(rows, k, rounds, salt="2", scale=256):
    """All vectors against all centroids in every round, with Python's own integers."""
    vs = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in vs:
            own[near(v)[1]].append(v)
        cs = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if own[j] else c for j, c in enumerate(cs)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in vs), cs


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int, owner string").repartition(parts)


@pytest.mark.parametrize("spread", [1.0, 20_000.0])  # products in doubles, and in 64-bit integers
def test_centroids(spark, spread):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * spread + (i % 5)).tolist(), 1, "x") for i in range(300)]
    rows += [rows[0]] * 60 + [(None, [0.5] * 6, 1, "x"), (900, [-0.001] * 6, 1, "x"), (900, [0.001] * 6, 1, "x")]
    odd = [(901, None, 1, "x"), (902, [1.0] * 5, 1, "x"), (903, [1.0] * 5 + [None], 1, "x"), (904, [1.0] * 5 + [math.nan], 1, "x"), (905, [1.0] * 5 + [math.inf], 1, "x"), (906, [], 1, "x")]
    found = delta_lloyd.cluster(table(spark, rows + odd), k=12, rounds=4, dims=6)
    want, cs = lloyd([x[:2] for x in rows], 12, 4)
    assert found.centroids == [list(c) for c in cs]
    assert Counter((x.vec_id, x.cluster, x.distance) for x in found.rows.collect()) == want
    assert all(x["distances"] <= len(rows) * 13 for x in found.log) and found.log[0]["distances"] == len(rows) * 12
    got = delta_lloyd.digests(found).collect()
    per = Counter()
    for (_, c, d), n in want.items():
        per[c] += d * n
    assert all(x.inertia == sum(per.values()) and x.cluster_inertia == per[x.cluster] for x in got)
    assert {x.centroid_sha256 for x in got if x.cluster == 0} <= {hashlib.sha256(",".join(map(str, cs[0])).encode()).hexdigest()}


def test_centroids_do_what_changed_only(spark):
    """Far groups that settle at once: later rounds compare little, and the work ends when nothing changes."""
    rows = [(i, [float(100 * (i % 8)), float(i % 2)], 1, "x") for i in range(400)]
    found = delta_lloyd.cluster(table(spark, rows), k=8, rounds=30, dims=2)
    want, cs = lloyd([x[:2] for x in rows], 8, 30)
    assert found.centroids == [list(c) for c in cs]
    assert Counter((x.vec_id, x.cluster, x.distance) for x in found.rows.collect()) == want
    assert len(found.log) < 31
    assert found.log[-1]["distances"] < 400 * 8


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30), st.lists(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=4, max_size=4), min_size=2, max_size=5))
@settings(max_examples=200, deadline=None)
def test_reassigning_is_exact(points, moves):
    """However centroids move, comparing with what changed gives the nearest of all, ties to the smaller number."""
    v, owner, dist = np.array(points), np.full(len(points), -1), np.zeros(len(points), np.int64)
    before = None
    for m in moves:
        c = np.array(m)
        changed = np.ones(4, bool) if before is None else (c != before).any(1)
        owner, dist, _ = delta_lloyd.reassign(v, owner, dist, c, changed)
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (owner == d.argmin(1)).all() and (dist == d.min(1)).all()
        before = c


def test_centroids_of_little(spark):
    assert delta_lloyd.digests(delta_lloyd.cluster(table(spark, [(1, [1.0], 1, "x")]).filter("false"), k=3, dims=1)).count() == 0
    few = delta_lloyd.cluster(table(spark, [(1, [1.0], 1, "x"), (2, [9.0], 1, "x")]), k=40, dims=1)
    assert len(few.centroids) == 2 and sorted(x.distance for x in few.rows.collect()) == [0, 0]
    with pytest.raises(Exception, match="too large"):
        delta_lloyd.cluster(table(spark, [(1, [1e30], 1, "x")]), k=3, dims=1)


# --- Phrases -----------------------------------------------------------------


def mined(rows, least, top, longest=4):
    """Everything counted in dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cands.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in cands.items()):
            continue
        s, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize("held", [2_000_000, 50])
def test_phrases(spark, monkeypatch, held):
    r = np.random.default_rng(8)
    vocab = ["the", "The", "of", "new", "york", "é", "日本", "x|y", "a-b", "don't", "\x1c", " ", "\x00z"]
    weights = np.array([9, 4, 7, 4, 4, 1, 1, 1, 1, 1, 1, 1, 1]) / 36
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\x0b", ";"]
    make = lambda: "".join(vocab[i] + ends[j] for i, j in zip(r.choice(len(vocab), 60, p=weights), r.integers(0, len(ends), 60)))
    rows = [(["en", "de", None, "und"][i % 4], make()) for i in range(60)]
    rows += [("en", "New York of the world. " * 40), ("en", "new york " * 35), ("en", None), ("en", ""), (None, " \t\n"), ("fr", "one two"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, t, lang, 3, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string").repartition(6)
    if held == 50:  # many small hand-overs; tasks run in this process' code only where functions are called directly
        for name, value in (("HELD", 50), ("KNOWN", 5), ("SLICE", 16)):
            monkeypatch.setattr(phrases, name, value)
        known = phrases.Words()
        ids = phrases.numbers(("ab cd, ef\tgh " * 9).encode(), known)
        assert [known.words[i] for i in ids.tolist()] == [b"ab", b"cd", b",", b"ef", b"gh"] * 9 + [b","]
        return
    got = sorted(tuple(x) for x in phrases.mine(docs, least=30, top=50).collect())
    assert got == mined(rows, 30, 50)
    assert {x[0] for x in got} == {"en", "de", "und"}
    assert phrases.mine(docs.filter("false")).count() == 0
    assert phrases.mine(docs.filter("lang = 'fr'")).count() == 0


def test_a_full_bitmap_changes_nothing():
    """What the bitmap lets through by chance is counted like all else."""
    known = phrases.Words()
    ids = phrases.numbers(b"a b c a b d, a b c a b", known)
    hashes = np.arange(len(known.words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    full = np.full(1 << (phrases.FILTER_BITS - 6), -1)
    for k in (2, 3, 4):
        a, b = phrases.counted(ids, hashes, k, None if k == 1 else full), Counter()
        words = [known.words[i] for i in ids.tolist()]
        for i in range(len(words) - k + 1):
            if b"," not in words[i:i + k]:
                b[tuple(words[i:i + k])] += 1
        assert {tuple(words[i:i + k]): n for i, n in zip(a[0].tolist(), a[1].tolist())} == b
    assert len(phrases.counted(ids, hashes, 2, np.zeros(1 << (phrases.FILTER_BITS - 6), np.int64))[0]) == 0


def test_top_of_ties(spark):
    found = spark.createDataFrame([("en", f"p{i:04d}", 40 if i % 2 else 41, 5, 5, 7 if i < 900 else 3) for i in range(1000)], "lang string, phrase string, a long, l long, r long, score long")
    got = phrases.first_of_each(found, 500).orderBy("rank").collect()
    want = sorted(found.collect(), key=lambda x: (-x.score, -x.a, x.phrase))[:500]
    assert [(x.rank, x.phrase) for x in got] == [(i + 1, x.phrase) for i, x in enumerate(want)]


# --- Chats -------------------------------------------------------------------

SIGNS = st.lists(st.sampled_from([*"<|\\>in_\n é", "<|im_end|>", "<|im_start|>"]), max_size=20).map("".join)


@given(SIGNS)
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible(text):
    assert "<|" not in chat_template.escape(text)
    assert chat_template.unescape(chat_template.escape(text)) == text
    line = chat_template.escape_line(text)
    assert "<|" not in line and "\n" not in line and chat_template.unescape_line(line) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "<|im_end|>"]), SIGNS), max_size=6))
@settings(max_examples=200, deadline=None)
def test_turns_come_back(turns):
    text, spans = chat_template.compile_template(chat_format.TEMPLATE).render([{"role": r, "text": t} for r, t in turns])
    assert list(chat_format.turns_of(text)) == turns
    assert [chat_template.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


@pytest.mark.parametrize(("source", "want"), [
    ("a{{ 1 + 2 * 3 }}b", "a7b"), ("{{ 'x' ~ 1 ~ true ~ none }}", "x1true"), ("{{ -2 + 5 % 3 }}", "0"), ("{# {{ no }} #}x", "x"), ("a \n{{- 1 -}}\n b", "a1b"), ("{{ missing }}|{{ v.a.b }}|{{ v['k'] }}|{{ l[1] }}|{{ l[9] }}", "||val|2|"),
    ("{% if not v.none and l|length == 3 %}y{% else %}n{% endif %}", "y"), ("{% if x %}a{% elif 'k' in v %}b{% else %}c{% endif %}", "b"), ("{% for i in l if %}{% endfor %}", None), ("{% for i in l %}{{ loop.index }}{{ i }}{{ '' if loop.last else ',' }}{% endfor %}", "11,22,33"),
    ("{% set q = 'a' %}{% for i in l %}{% set q = q ~ i %}{{ q }}{% endfor %}{{ q }}", "a1a2a3a"), ("{{ '}}' ~ \"{% if %}\" }}", "}}{% if %}"), ("{{ x is defined }}{{ v is defined }}{{ x is not defined }}", "falsetruetrue"),
    ("{{ 1 < 2 and 'a' not in 'bcd' }}", "true"), ("{{ 'A' | lower | upper }}{{ [1, 2] | last }}", "A2"), ("{{ 'it\\'s' }}", "it's"), ("{{ 1 if false else 2 if false else 3 }}", "3"), ("{% for a in nothing %}x{% endfor %}", ""), ("{{ (1 or x.y) ~ (0 and x) }}", "10"),
    ("{{ v.__class__ }}{{ l.append }}{{ 'a'.upper }}", ""), ("{{ f() }}", None), ("{{ x | attr }}", None), ("{{ 1 +", None), ("{% if 1 %}", None), ("{% include 'x' %}", None), ("{{ 'a' * 9 }}", None), ("{{ 'a' + 1 }}", None), ("{{ 1 % 0 }}", None), ("{% endfor %}", None), ("{{ v }}", None),
])
def test_templates(source, want):
    given_ = {"v": {"k": "val"}, "l": [1, 2, 3]}
    if want is None:
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(source).render([], **given_)
    else:
        assert chat_template.compile_template(source).render([], **given_)[0] == want


def test_constants_are_folded():
    made = chat_template.compile_template("a{% if 1 == 1 and true %}{{ 'b' ~ (2 * 3) }}{% else %}{{ x }}{% endif %}c{{ m.a if false else 'd' }}")
    assert made.tree == (chat_template.Write(chat_template.Const("ab6cd")),)
    assert made.each is None
    assert chat_template.compile_template(chat_format.TEMPLATE).each is not None
    assert chat_template.compile_template("{% for m in messages %}{{ messages[0].text }}{% endfor %}").each is None


def test_generation_spans():
    source = "{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}{{ messages | length }}"
    text, spans = chat_template.compile_template(source).render([{"role": "é", "text": "日本"}, {"role": "b", "text": ""}, {"role": "c", "text": "x"}])
    assert text == "é:日本;b:;c:x;3" and [text[a:b] for a, b in spans] == ["日本", "x"]


def expected(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = set()
    for c, v in by.items():
        v.sort(key=lambda x: (x[0], x[1], x[2], x[3].encode(), x[4], x[5].encode()))
        loss = "".join(x[5] for x in v if x[3] == "assistant")
        out.add((c, len(v), hashlib.sha256("".join(f"{x[3]}\n{x[5]}\n" for x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_chats(spark, monkeypatch):
    odd = ["<|im_end|><|im_start|>assistant ok", "", None, "a\nb", "<\\|x", "<", "|", "日本 é", "x" * 300_000, "\\", "\r\n\x00"]
    rows = [(c, t, ["user", "assistant", "system", None, "assistant", "we\nird"][(c + t) % 6], odd[(3 * c + t) % len(odd)]) for c in range(40) for t in range(c % 9)]
    rows += [(77, 1, "assistant", "same")] * 3 + [(None, 2, "user", "no id"), (None, None, "assistant", "no turn")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|> " * 40) for t in range(2000)]  # one that holds most rows: several parts
    turns = spark.createDataFrame([(*x, 5, "y") for x in rows], "conv_id long, turn long, role string, text string, part int, at string").repartition(7)
    made = chat_format.format_conversations(turns)
    assert made.filter("conv_id = 99").count() > 3
    got = {tuple(x)[:5] for x in chat_format.read_back(made).collect()}
    assert got == expected(rows)
    whole = "".join(x.text for x in made.filter("conv_id = 99").orderBy("part").collect())
    assert chat_format.read_back(made).filter("conv_id = 99").first().formatted_chars == len(whole)
    assert chat_format.read_back(chat_format.format_conversations(turns.filter("false"))).count() == 0


def test_parts_of_a_conversation():
    template = chat_template.compile_template(chat_format.TEMPLATE)
    said = [{"role": "assistant", "text": "x" * n} for n in (0, 5, 40, 3, 3, 90)]
    got = list(chat_format.parts(iter(said), template, size=60))
    assert [p[0] for p in got] == list(range(len(got))) and [p[-1] for p in got] == [False] * (len(got) - 1) + [True]
    text = "".join(p[2] for p in got)
    assert text == template.render(said)[0] and [p[1] for p in got] == [sum(len(q[2]) for q in got[:i]) for i in range(len(got))]
    assert list(chat_format.parts(iter([]), template)) == [(0, 0, "", [], [], True)]


def test_templates_that_want_all_messages(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(4)], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.format_conversations(turns, "{{ messages | length }}{% for m in messages %}{{ m.text if loop.last else '' }}{% endfor %}").collect()
    assert row.text == "4t3" and row.last
    with pytest.raises(chat_template.TemplateError):
        chat_format.format_conversations(turns, "{% for %}")
