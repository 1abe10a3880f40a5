"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import hashlib
import html as entities
import math
import random
import re

import numpy as np
import pytest
import xxhash
from compare import DATA, duck, same
from pyspark.sql import functions as F

from lodestrata.llm import bpe, common, components, html, jaccard, kernel, licenses, mixing, quality, quotes, registry, search, toxicity, winnowing

DIR = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, "Released under the MIT License.\nthe  cat sat", "en", "a", 3, 0.0), (2, None, None, None, None, None), (3, "", "en", "a", 0, 0.0), (4, "   \n\t ", "en", "b", 1, 0.0), (None, "the cat sat on the mat", "en", "b", 1, 0.0),
    (5, "the cat sat on the mat", "en", "b", 1, 0.0), (5, "the cat sat on the mat", "en", "b", 1, 0.0), (6, "one", "fr", None, 3, 0.0), (7, "wörd " * 3000, "de", "c", 9, 1.0), (8, "x" * 20000, "de", "c", 9, 1.0), (9, "THE CAT SAT ON THE MAT", "en", "a", 1, 0.0),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def shingled(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """rows: (id, text). Component of every place in rows."""
    sets, up = [shingled(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x) for x in row)


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out = []
    passage = [word() for _ in range(60)]
    for g in range(3):
        base = [word() for _ in range(90)]
        for c in range(70):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = word()
            out.append((1000 * g + c, " ".join(t)))
    out += [(9000 + i, " ".join(passage + [word() for _ in range(rng.randint(3, 25))])) for i in range(80)]
    return out


def test_jaccard_brute_force(spark, edge):
    rows = near_copies() + [(r[0], r[1]) for r in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_jaccard_empty_and_deduplicate(spark, empty, edge):
    assert jaccard.join(empty).collect() == []
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.deduplicate(edge).collect())
    assert kept[(5, "the cat sat on the mat")] == 1 and (9, "THE CAT SAT ON THE MAT") not in kept and kept[(None, "the cat sat on the mat")] == 1
    assert {1, 2, 3, 4, 6, 7, 8} <= {d for d, _ in kept}


def test_deduplicate_tells_rows_of_one_id_apart(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    # id 5 goes for text a, which 1 has, but not for c, nor for b, whose least id it is; 7 goes for b
    rows = [(1, a, 10), (5, a, 20), (5, b, 30), (5, c, 40), (5, c, 40), (7, b, 50), (8, "x y z", 60), (None, a, 70)]
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(r.n for r in got.collect()) == [10, 30, 40, 60, 70]


def test_components_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}


def test_kernel_words_and_packing():
    import pyarrow as pa

    texts = [b"", b"  a bb\tccc ", b"bb", None, b"a b c d e f"]
    for _, buf, offsets in kernel.pieces(pa.array(texts), 4):
        starts, ends, at = kernel.words(buf, offsets)
        assert len(starts) == len(ends) and at[-1] == len(starts)
    assert (jaccard.unpack(jaccard.pack(np.array([1, 1, 7, 2**32 - 1]))) == np.array([1, 1, 7, 2**32 - 1])).all()


def test_licenses_same_as_sql(spark, docs, edge, empty):
    same(licenses.scan(docs), duck(DIR), licenses.sql())
    assert licenses.scan(empty).collect() == []
    got = {r.doc_id: r for r in licenses.scan(edge).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (8, 1, 3, "mit", "mit", 1.0)
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[2].score == 0.0


def test_licenses_wrapped(spark):
    """Every notice, wrapped narrowly, behind comment marks and line numbers, far into a text, is found as on one line."""
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        ws = t.split()
        lines = [" ".join(ws[k : k + 4]) for k in range(0, len(ws), 4)]
        rows += [(10 * i, t), (10 * i + 1, "\n".join(lines)), (10 * i + 2, "word\n" * 500 + "\n".join(f" * {k} {x}" for k, x in enumerate(lines, 100)) + "\nword" * 500)]
    rows.append((999, "\n".join("permission granted to any person copy software files deal without restriction associated including".split() * 1 + ["word"] * 80) + "\nobtaining of this and documentation the in charge free hereby"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[10 * i][0].split(",") and got[10 * i] == got[10 * i + 1] == got[10 * i + 2], (label, got[10 * i], got[10 * i + 1], got[10 * i + 2])
    assert got[999] == ("", 0.0)  # words far apart are no notice


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, out, left = set(order), {}, sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        for s in over or free:
            out[s] = cap * sizes[s] if over else left * w[s] / total
        if not over:
            break
        left -= sum(cap * sizes[s] for s in over)
        free -= set(over)
    return out


def test_mixing(spark, docs, edge, empty):
    assert mixing.mix(empty).collect() == [] and mixing.apply(empty).collect() == []
    for df in (docs, edge):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken = collections.Counter(), collections.Counter()
        for r in rows:
            n = len(WORD.findall(r.text or ""))
            assert r._size == n and 0 <= r._taken <= 3 * n
            sizes[r.source] += n
            taken[r.source] += r._taken
        want = brute_targets(sizes)
        for r in rows:
            assert math.isclose(r._target, want[r.source], abs_tol=1e-6) and r._source_size == sizes[r.source]
        assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
        assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, rows))
        made = collections.Counter()
        for r in mixing.apply(df).collect():
            made[r.source] += len(WORD.findall(r.text))
        assert made == +taken


def test_apportionment_is_highest_quotients(spark):
    votes = [53, 24, 23, 1, 0, 7]
    for seats in (0, 1, 5, 20, 101):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "p int, v double")
        got = {r.p: r.n for r in mixing.apportion(df, [], "p", "v", F.lit(seats), "n").collect()}
        won = collections.Counter(i for _, i, _ in sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(seats)))[:seats])
        assert got == {i: won[i] for i in range(len(votes))}


def held_out(spark, df, column, n, at):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    rows = [r for r in df.collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 300
    return sum(labels[r.doc_id] == r.predicted for r in rows) / len(rows)


def test_quality_held_out(spark):
    assert held_out(spark, registry.op4_quality_classifier(spark, f"{DATA}/sf0.1"), "quality", 3, 1) > 0.98


def test_toxicity_held_out(spark):
    assert held_out(spark, registry.op5_toxicity(spark, f"{DATA}/sf0.1"), "toxic", 5, 0) > 0.97


def test_classifier_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, 1, None), (5, 0, 1), (None, 1, 1), (77, 1, 0)], "doc_id long, toxic int, quality int")
    for labels in (none, some):
        for module in (quality, toxicity):
            for df in (edge, empty):
                model = module.train(df, labels, F.lit(True))
                scores = module.score(df, model, ["doc_id"]).collect()
                assert len(scores) == df.count() and all(0 <= r.score <= 1 for r in scores)


def test_restoring(spark):
    r = toxicity.Restorer(toxicity.costs(toxicity.trigram_counts(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))))
    assert [r.word(w) for w in ("1d10t", "st.u.p.i.d", "looooser", "$tupid!!", "plain", "trech###", "1234")] == ["idiot", "stupid", "loser", "stupid", "plain", "trech", "1234"]
    assert r.words("you i d i o t !")["idiot"] == 1


def test_restoring_doubled(spark):
    cost = toxicity.costs(toxicity.trigram_counts(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")))
    r = toxicity.Restorer(cost)
    doubled = {"iddiot": "idiot", "stuupid": "stupid", "traash": "trash", "morron": "moron", "scuum": "scum", "patthetic": "pathetic", "losser": "loser"}
    assert {w: r.word(w) for w in doubled} == doubled
    # a spelling that has the letters twice stays known by itself, and counts once
    assert "letter" in toxicity.features(next(iter(r.words("letter"))))
    m = toxicity.Model(cost, {"letter": 3.0, "leter": 3.0, "idiot": 4.0}, np.zeros(4))
    assert m.evidence(r.words("letter"), {}) == (3.0, 3.0, math.log1p(1)) and m.evidence(r.words("an iddiot"), {})[0] == 4.0


def every_reading(channel, token):
    """(cost, letters) of all paths through a token's lattice, one by one."""
    paths = [(0.0, "")]
    for i, c in enumerate(token):
        paths = [(z + extra, w + x) for z, w in paths for x, _, extra in channel.arcs(c, token[i - 1] if i else "")]
    table = channel.cost
    code = lambda x: channel.code.get(x, 0)
    spell = lambda w: sum(table[(code(a) * 64 + code(b)) * 64 + code(c)] for a, b, c in zip("  " + w, " " + w + " ", w + " ", strict=False))
    return [(z + spell(w), w) for z, w in paths]


@pytest.mark.parametrize("token", ["", "a", "stuupid", "iddiot", "1d10t", "!d!ot", "l00ser", "m*ron", "tr@sh", "aabb11", "x²y", "555", "ñoññ$", "s-t-u"])
def test_viterbi_finds_the_cheapest_of_all_paths(spark, token):
    channel = toxicity.Channel(toxicity.costs(np.random.default_rng(1).integers(0, 50, 64**3)))
    cost, word = channel.best(token)
    paths = every_reading(channel, token)
    assert math.isclose(cost, min(p[0] for p in paths)) and any(w == word and math.isclose(z, cost) for z, w in paths)


def test_toxicity_weights_and_scorer(spark):
    """Weights against a plain count, and the scorer's evidence against that of all restored words."""
    folder = f"{DATA}/sf0.01"
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(400).collect()]
    cost = toxicity.costs(toxicity.trigram_counts(spark.read.parquet(f"{folder}/documents.parquet")))
    r = toxicity.Restorer(cost)
    rows = [(int(i % 3 == 0 or "stupid" in (t or "")), i % 2, sorted(r.words(t, True))) for i, t in enumerate(texts)]
    got = toxicity.weigh(spark.createDataFrame(rows, "y int, half int, words array<string>"))
    for k, mine in enumerate((lambda h: h == 0, lambda h: h == 1, lambda h: True)):
        n, have = collections.Counter(y for y, h, _ in rows if mine(h)), {0: collections.Counter(), 1: collections.Counter()}
        for y, h, ws in rows:
            if mine(h):
                have[y].update({f for w in ws for f in toxicity.features(w)})
        want = {}
        for f, m in have[1].items():
            c = have[0][f]
            odds = math.log((m + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
            if m >= toxicity.LEAST and c <= toxicity.COMMON * n[0] and odds > 2:
                want[f] = odds
        assert got[k].keys() == want.keys() and all(math.isclose(got[k][f], x) for f, x in want.items())
    m = toxicity.Model(cost, got[2] | {"stupid": 4.0, "idio~": 4.0, "as": 2.5}, np.array([-5.0, 1, 1, 1]))
    s = toxicity.Scorer(m)
    odd = ["you are a s t u p i d", "1d10ts, st up id!", "a.s", "ass as", "!diot's $tupid", "x² s²tupid", None, "", "st-upid idiiot id iot"]
    for t in texts + odd:
        assert s.evidence(t) == m.evidence(toxicity.Restorer(cost).words(t, True) if t in odd else r.words(t, True), {})
    assert sum(s.evidence(t)[0] > 0 for t in odd) >= 5


def test_training_takes_an_id_once(spark):
    rows = [(1, "b", "x"), (1, "a", "y"), (2, None, "z")] * 3
    docs = spark.createDataFrame([(str(i), t, s) for i, t, s in rows], "doc_id string, text string, y string")
    labels = spark.createDataFrame([("1", 1), ("1", 0), ("2", 0), (None, 1)], "doc_id string, toxic int")
    got = common.training_rows(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [("1", 1), ("2", 0)] and {r.text for r in got} <= {"a", "b", None}


def test_restoring_spaced(spark):
    cost = toxicity.costs(toxicity.trigram_counts(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")))
    r, m = toxicity.Restorer(cost), toxicity.Model(cost, {"idiot": 4.0, "stupid": 4.0, "loser": 4.0}, np.zeros(4))
    spaced = {"you are a s t u p i d": "stupid", "I i d i o t": "idiot", "a st up id man": "stupid", "an id iot": "idiot", "stu pid": "stupid", "i d i o t l o s e r": "idiot loser", "l 0 s e r": "loser", "!diot": "idiot", "you (!diot": "idiot", "s t u p i d !diot": "stupid idiot", "i d l e r it is (loud)": ""}
    for text, want in spaced.items():
        restored = {w for readings in r.words(text) for w in readings.split(" ")}
        assert restored & set(m.weights) == set(want.split()), text
        most, _, n = m.evidence(r.words(text, True), {})
        assert most == (4.0 if want else 0.0) and n >= math.log1p(len(want.split())), text


def test_html(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages, ["page_id", "url"]).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<br>|</?b>", " " if "br" in p else "", p)).split()) for p in re.split(r"</?(?:h1|p)>", re.sub("<br>", " ", article)))
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<article><p>A &lt;b&gt; c &eacute;<br>d<script>x('</p>')</script></article><div id=comments><p>no</p></div><footer>f") == "A <b> c é d"
    assert html.main_text("<!-- open") == "" and isinstance(html.main_text("<p" + ">x<" * 5), str)


def test_html_keeps_what_is_inside():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, and <object data=a.swf>the <b>fallback</b></object> too, <canvas>a chart</canvas> and <noscript>no script</noscript> end.</p></article>"
    assert html.main_text(page).replace(" ", "") == "Letx=2hold,andthefallbacktoo,achartandnoscriptend."


def brute_winnow(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    """[(hash, position)]: the rightmost least hash of every run, hashes by the xxhash library."""
    h = [xxhash.xxh64_intdigest(text[i : i + k].encode("utf-32-be"), 42) for i in range(len(text) - k + 1)] or ([xxhash.xxh64_intdigest(text.encode("utf-32-be"), 42)] if text else [])
    h = [(x - (1 << 64) if x >> 63 else x) >> 32 for x in h]
    return sorted({max((-x, i) for i, x in enumerate(h[j : j + w], j)) for j in range(max(1, len(h) - w + 1))}, key=lambda p: p[1]) if h else []


def test_winnowing(spark, docs, edge, empty):
    assert winnowing.compare(empty).collect() == []
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in winnowing.compare(docs).collect()}
    assert len(got) == len(rows)

    def digest(p):
        return hashlib.sha256(",".join(str(i << 32 | -x & 0xFFFFFFFF) for x, i in p).encode()).hexdigest()

    def like(p, q):
        a, b = {x for x, _ in p}, {x for x, _ in q}
        return len(a & b) / len(a | b) if a | b else 1.0

    prints = [brute_winnow(t) for _, t in rows]
    for i, (d, t) in enumerate(rows):
        half, k = len(t) // 2, (i + 1) % len(rows)
        edited = t[: len(t) - half] + rows[k][1][:half]
        other, r = brute_winnow(edited), got[d]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert (r.fingerprint, r.edited_fingerprint) == (digest(prints[i]), digest(other))
        assert (r.near_edited, r.near_next) == (like(prints[i], other), like(prints[i], prints[k]))
        assert r.positions == ",".join(str(i) for _, i in prints[i])
    edges = winnowing.compare(edge).collect()
    assert len(edges) == len(EDGE) and len({r.fingerprint for r in edges if r.doc_id == 5}) == 1


def test_winnowing_string_ids(spark):
    rows = [("b", "x" * 40), ("a", "wörld \U0001f600 " * 9), (None, None), ("c", "")]
    got = {r.doc_id: r for r in winnowing.compare(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["a"].positions == ",".join(str(i) for _, i in brute_winnow(rows[1][1])) and got["a"].n_chars == len(rows[1][1])
    assert got[None].positions == got["c"].positions == "" and got[None].n_chars == 0 and len(got) == 4


@pytest.mark.parametrize("n", [1, 15, 16, 17, 30, 31, 32, 46, 47, 48, 60])
def test_winnowing_rightmost(spark, n):
    t = spark.createDataFrame([(1, "a" * n)], "k int, text string")
    pos = [x.pos for x in winnowing.fingerprints(t, ["k"], "text").select(winnowing.positions(F.col("fingerprint")).alias("p")).first().p]
    assert pos == [i for _, i in brute_winnow("a" * n)]  # the right end of every run


def test_quotes(spark):
    m = [
        (1, 0, "user", "Hello  there.\nSecond line."), (1, 1, "assistant", "An answer."), (1, 2, "user", "> An answer.\n\nWhy?"), (1, 3, "user", "> hello there.\n> Second line.\nAbout the first."),
        (1, 4, "assistant", ">> An  answer.\n> Why?\nBecause."), (1, 5, "user", "> nowhere\nfoo"), (1, 6, "user", "> Because.\nok"), (None, 0, "user", None), (None, None, None, "x"), (2, 0, "user", "> Hello"), (2, 0, "user", "> Hello"), (3, 0, "u", ""),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    paths = {(r.conv_id, r.turn): (r.path, r.reply_to, r.n_quotes, r.n_linked) for r in quotes.thread(df).collect()}
    assert paths[1, 4] == ([1, 2, 4], 2, 2, 2) and paths[1, 6] == ([1, 2, 4, 6], 4, 1, 1) and paths[1, 3] == ([0, 3], 0, 1, 1) and paths[1, 5] == ([5], None, 1, 0)
    out = {r.conv_id: r for r in quotes.conversations(df).collect()}
    assert out[1].text.split("\n<|") [1:3] == ["user|>\nAbout the first.", "assistant|>\nAn answer."]
    assert out[2].n_turns == 2 and out[None].n_turns == 2 and out[3].text == "<|u|>\n"
    assert quotes.conversations(df.limit(0)).collect() == []


def test_quotes_of_parts_and_of_nothing(spark):
    m = [
        (1, 0, "u", "First of all, a long line. The part that counts! And more.\n\nNext paragraph here\nis wrapped."), (1, 1, "a", "Something else."),
        (1, 2, "u", "> The part that\n> counts!\nYes."), (1, 3, "a", "> next paragraph\n> here is\n> wrapped.\nAgreed."),
        (1, 4, "u", "> a saying from outside\n\nSee:\n>>> print(1)\n1\n> Something else.\nDone."), (1, 5, "a", "> The part that counts! And\n> more.\nTwo sentences."),
    ]
    got = {r.turn: r for r in quotes.thread(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(6)] == [None, None, 0, 0, 1, 0]
    assert (got[2].body, got[3].body, got[5].body) == ("Yes.", "Agreed.", "Two sentences.")
    assert got[4].body == "> a saying from outside\n\nSee:\n>>> print(1)\n1\nDone." and (got[4].n_quotes, got[4].n_linked) == (3, 1)


def test_quotes_long_conversations(spark):
    rows = [(c, t, "u", f"{c} says {t}") for c in (1, None) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {c: "\n".join(f"<|u|>\n{c} says {t}" for t in range(3000)) for c in (1, None)}
    assert {r.conv_id: (r.part, r.n_turns, r.text) for r in quotes.conversations(df).collect()} == {c: (0, 3000, want[c]) for c in want}
    parts = quotes.conversations(df, part_bytes=5000).collect()
    assert len(parts) > 8 and max(len(r.text) for r in parts) < 5100
    for c in want:
        assert "\n".join(r.text for r in sorted(parts, key=lambda r: r.part) if r.conv_id == c) == want[c]


def test_signatures_never_rule_out_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for i in range(60):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 4))).astype(np.uint64))))
        if len(b):
            rows += [(2 * i, a.tobytes(), len(a)), (2 * i + 1, b.tobytes(), len(b))]
            both = len(np.intersect1d(a, b))
            truth[i] = 4 * both >= 3 * (len(a) + len(b) - both)
    sizes = {r[0]: r[2] for r in rows}
    sig = jaccard.signatures(spark.createDataFrame([r[:2] for r in rows], "node long, tokens binary"))
    one, two = (sig.where(F.col("node") % 2 == k).select(F.floor(F.col("node") / 2).alias("i"), F.col("sig").alias(f"s{k}")) for k in (0, 1))
    n = spark.createDataFrame([(i, sizes[2 * i], sizes[2 * i + 1]) for i in truth], "i long, n0 int, n1 int")
    got = {r.i: r.ok for r in one.join(two, "i").join(n, "i").select("i", jaccard.alike(F.col("s0"), F.col("n0"), F.col("s1"), F.col("n1")).alias("ok")).collect()}
    assert any(truth.values()) and all(got[i] for i in truth if truth[i]) and not all(got.values())


def test_mixing_takes_columns_of_its_own_names(spark, edge):
    df = edge.withColumns({"_shard": F.lit(1), "_size": F.lit("x"), "kept_shard": F.lit(2)})
    plain, got = mixing.apply(edge), mixing.apply(df)
    assert got.columns == df.columns
    assert sorted(map(repr, got.select(*edge.columns).collect())) == sorted(map(repr, plain.collect()))


def test_chats_whole_table(spark):
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").collect()
    want = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append(f"<|{r.role}|>\n{r.text}")
    got = {r.conv_id: r.text for r in registry.op8_chat_formatting(spark, DIR).collect()}
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_bpe_same_as_library(spark, docs, edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(3)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "1", "é", "中", "🙂", "\x1c", "\x85", "<|endoftext|>", "!!!", "\x00", "İ", "aaaa", "    "]
    odd = spark.createDataFrame([(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(500)], "doc_id long, text string")
    for df in (docs, edge, odd):
        got = {(r.doc_id, r.text): r for r in bpe.encode(df, ["doc_id", "text"]).collect()}
        back = {(r.doc_id, r.t): r.text for r in bpe.decode(bpe.encode(df, ["doc_id", "text"]).withColumnRenamed("text", "t"), ["doc_id", "t"]).collect()}
        digests = bpe.digests(df, ["doc_id", "text"]).collect()
        for (d, text), r in got.items():
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
            assert back[d, text] == t.decode(ids, skip_special_tokens=False)
        for r in digests:
            assert r.ids_sha256 == hashlib.sha256(got[r.doc_id, r.text].ids).hexdigest()
    assert bpe.encode(empty, ["doc_id"]).collect() == []


def test_workers_give_memory_back(docs, monkeypatch):
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append((self, f)) or self)
    jaccard.members(docs, "doc_id", "text", [])
    bpe.encode(docs, ["doc_id"])
    (rows, members), (texts, encode) = made
    assert sum(len(b) for b in members(iter(rows.toArrow().to_batches()))) == docs.count() and not kernel._powers
    kernel.release()
    kernel.powers(1)
    assert sum(len(b) for b in encode(iter(texts.toArrow().to_batches()))) == docs.count() and not kernel._powers
    kernel.release()


def test_join_workers_stay_small(spark, docs, monkeypatch):
    made, given = [], []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(f) or plain(self, f, schema))
    some = docs.where("doc_id < 60")
    top = jaccard.frequent(some, "text")
    sets = jaccard.sets_of(some, "text", jaccard.members(some, "doc_id", "text", []).select("node"))
    jaccard.candidates(jaccard.index(some, "text", top))
    jaccard.verify(spark.createDataFrame([], "a long, b long"), sets)
    jaccard.signatures(sets)
    quality.score(some, None, ["doc_id"])
    toxicity.score(some, None, ["doc_id"])
    monkeypatch.undo()
    kernel.release()
    monkeypatch.setattr(kernel, "trim", lambda: given.append(1))
    monkeypatch.setattr(toxicity, "Scorer", lambda model: None)
    for i, f in enumerate(made, 1):
        list(f(iter([])))
        assert len(given) == i
    assert len(made) == 10


def test_join_takes_texts_in_small_runs():
    import pyarrow as pa

    kernel.trim()
    rows = [b" ".join(b"w%d" % (i * j) for j in range(100)) for i in range(4000)]
    ((_, sets),) = jaccard._sets(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])]), 0)
    assert len(sets) == len(rows) and all(a.tolist() == kernel.shingles(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist() for a, r in zip(sets[::500], rows[::500], strict=True))
    assert len(kernel._powers["up"]) <= 1 << 19
    kernel.trim()


def test_bpe_walks_a_word_once(monkeypatch):
    walked = []
    walk = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda v, words: walked.extend(words) or walk(v, words))
    with open(bpe.default_path(), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    for texts in (["say hello world"], ["say hello, hello; world! world"], ["(hello) world?"]):
        e.encode(texts)
    assert len(walked) == len(set(walked))


def test_bpe_small_cache(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "PAIRS", 8)
    with open(bpe.default_path(), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    rng = random.Random(5)
    for _ in range(100):
        texts = [" ".join("".join(rng.choices("abtheé中!'s1", k=rng.randint(1, 5))) for _ in range(4)) for _ in range(3)]
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(e.pieces) + len(e.older) <= 160


def brute_search(rows, asked, k):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for _, t in rows]
    tf = [collections.Counter(w) for w in words]
    df = collections.Counter(w for c in tf for w in c)
    n, average = len(rows), sum(map(len, words)) / len(rows)
    out = {}
    for q, text in asked:
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
        s = [(-sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in own if w in c), d) for (d, _), ws, c in zip(rows, words, tf, strict=True)]
        out[q] = sorted(x for x in s if x[0] < 0)[:k]
    return out


@pytest.mark.parametrize("shard,block,query_words", [(8192, 64, 1_000_000), (16, 4, 300)])
def test_search_brute_force(spark, docs, monkeypatch, shard, block, query_words):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SEED", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    got = collections.defaultdict(list)
    for r in sorted(search.search(docs, asked, query_words=query_words).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.score, r.doc_id))
    for q, want in brute_search(rows, [(d, t) for d, t in rows if d % 20 == 0], search.K).items():
        assert [d for _, d in got[q]] == [d for _, d in want]
        assert all(math.isclose(a, -b) for (a, _), (b, _) in zip(got[q], want, strict=True))


@pytest.mark.parametrize("left", [1.25, 1e9])
def test_search_adds_frequent_words_for_many_queries_at_once(monkeypatch, left):
    monkeypatch.setattr(search, "LEFT", left)
    rng = np.random.default_rng(7)
    texts, words, k = 400, 300, 5
    has = rng.random((texts, words)) < np.concatenate((np.full(40, 0.3), np.full(words - 40, 0.02)))
    has[-20:] = has[:20]  # equal texts, so equal scores
    impact = np.where(has, rng.random(words) * 3 + 1e-3, 0.0)
    shard = search.Shard(np.arange(texts), has.sum(1), np.nonzero(has)[1].astype(np.int32), impact[has], words, 16)
    queries = [np.sort(rng.choice(words, n, False)) for n in (1, 2, 5, 60, 200, 300)]
    added = []
    plain = search.sums
    monkeypatch.setattr(search, "sums", lambda at, value, starts, ends, n: added.append(int((ends - starts).sum())) or plain(at, value, starts, ends, n))
    often = shard.often(queries)
    assert not added and len(shard.rows) >= 40
    for q, row in zip(queries, often, strict=True):
        want = impact[:, q].sum(1)
        assert np.allclose(row, impact[:, [w for w in q if shard.row[w] >= 0]].sum(1), rtol=1e-5)
        scores = np.array([sum(impact[t, w] for w in q) for t in range(texts)])
        order = np.lexsort((np.arange(texts), -scores))[:k]
        order = order[scores[order] > 0]
        for floor in (0.0, scores[order[-1]] * 0.7, scores[order[-1]]):
            got = shard.search(q, k, (np.zeros(0), np.zeros(0, np.int64)), floor, row)
            assert got[1].tolist() == order.tolist() and np.allclose(got[0], want[order])
    assert all(n <= has[:, 40:].sum() for n in added)


def test_search_edges(spark, edge, empty):
    asked = edge.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    assert search.search(empty, asked).collect() == [] and search.search(edge, asked.limit(0)).collect() == []
    got = [r.doc_id for r in sorted(search.search(edge, asked.where("query_id = 6")).collect(), key=lambda r: r.rank)]
    assert got == [6]


def test_search_repeated_queries(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    (a, x), (b, y), (c, z) = [r for r in rows if r[1]][:3]
    # a twice alike, b with two texts
    asked = spark.createDataFrame([(a, x), (a, x), (b, y), (b, z), (c, z)], "query_id long, query_text string")
    got = collections.defaultdict(list)
    for r in sorted(search.search(docs, asked).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.doc_id))
    for q, want in brute_search(rows, [(a, x), (b, f"{y} {z}"), (c, z)], search.K).items():
        assert got[q] == [(i, d) for i, (_, d) in enumerate(want, 1)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, DIR)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    want = {c for d, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want <= ids
    out = corpus_pipeline.run(spark, DIR).collect()
    assert out and all(len(r.ids) == 4 * r.n_tokens for r in out)
