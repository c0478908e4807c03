"""Scoring, mixing, token output, language, decontamination, quality and HTML extraction."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_brute import hits, words
from pyspark.sql import functions as F

from permuta.llm import decontaminate, hmm, html_extract, language, mixing, quality, token_output
from permuta.llm.html_extract import extract, extract_pages
from permuta.llm.quality import held_out

RNG = random.Random(5)
EN, DE = "the of and that with from have this will your".split(), "der die und das mit von haben nicht wird auch".split()
FR, ES = "le la et que avec pour dans est une des".split(), "el los y que con para en es una del".split()


def prose(vocabulary, n):
    return " ".join(RNG.choice(vocabulary) + RNG.choice(["", "", "a", "en", "x"]) for _ in range(n))


def test_scores(docs, scratch):
    rows = [prose(RNG.choice((EN, DE)), RNG.randint(1, 60)) for _ in range(60)] + [None, "", "unseenword", "The\tTHE \n the", "a " * 3000]
    d = docs(rows).withColumn("ids", F.lit(1)).withColumn("row", F.lit(1))
    got = {r["doc_id"]: r for r in hmm.score_texts(d, held_out(F.col("doc_id"), 7, 2), scratch).collect()}
    token = {i: words(t) + [None] for i, t in enumerate(rows)}
    out = {i for i in token if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in token.items() if i not in out for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in token.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in out, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)


def test_forward_sums_over_all_state_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [np.array(x, np.uint16) for x in ([0], [1, 4], [2, 2, 3, 0, 1], [4, 0, 1])]
    for s, got in zip(seqs, hmm.forward(model, [x.tobytes() for x in seqs]), strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert math.isclose(got, math.log10(total), abs_tol=1e-12)
    start, moves, emissions = hmm.expected_counts(model, seqs)
    assert math.isclose(start.sum(), 4) and math.isclose(moves.sum(), sum(map(len, seqs)) - 4) and math.isclose(emissions.sum(), sum(map(len, seqs)))


@pytest.mark.parametrize(("piece", "words_"), [(1, 1), (2, 3), (3, 100), (100, 4)])
def test_expected_counts_sum_over_all_state_paths(monkeypatch, piece, words_):
    """Whole texts count, wherever pieces and blocks of them end."""
    from itertools import product

    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "WORDS", words_)
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 1, 7, 2, 6)]
    start, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        paths = list(product(range(3), repeat=len(s)))
        p = [model.start[x[0]] * np.prod([model.emit[w, z] for w, z in zip(s, x, strict=True)]) * np.prod([model.move[i, j] for i, j in zip(x, x[1:])]) for x in paths]
        for x, share in zip(paths, np.array(p) / sum(p), strict=True):
            start[x[0]] += share
            for i, j in zip(x, x[1:]):
                moves[i, j] += share
            for w, z in zip(s, x, strict=True):
                emissions[w, z] += share
    for got, want in zip(hmm.expected_counts(model, seqs), (start, moves, emissions), strict=True):
        assert np.allclose(got, want, rtol=1e-10, atol=1e-12)


def test_expected_counts_of_a_very_long_text(monkeypatch):
    rng = np.random.default_rng(4)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(50), 3).T)
    seqs = [rng.integers(0, 50, n).astype(np.uint16) for n in (5000, 3, 700)]
    monkeypatch.setattr(hmm, "PIECE", 10_000)
    whole = hmm.expected_counts(model, seqs)
    monkeypatch.setattr(hmm, "PIECE", 64)
    monkeypatch.setattr(hmm, "WORDS", 1000)
    for got, want in zip(hmm.expected_counts(model, seqs), whole, strict=True):
        assert np.allclose(got, want, rtol=1e-8)
    assert all(not x.any() for x in hmm.expected_counts(model, []))


def test_scores_without_training_rows(docs, scratch):
    assert hmm.score_texts(docs([]), held_out(F.col("doc_id"), 7, 2), scratch).count() == 0
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = hmm.score_texts(docs([(i, "some words") for i in only]), held_out(F.col("doc_id"), 7, 2), scratch.__class__(scratch.spark, "again")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2


def test_mix(docs):
    rows = [(i, "w " * RNG.randint(0, 40), "en", RNG.choice(["a", "b", "c", None])) for i in range(400)] + [(900, None, None, "z"), (None, "w", None, "b"), (7, "w w", None, "é")]
    d = docs(rows).withColumn("_source", F.lit("x")).withColumn("mix_size", F.lit(1))
    got = mixing.with_copies(d).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        assert r["mix_size"] == len(words(r["text"])) and 0 <= r["mix_copies"] <= 3
        size[r["source"]] += r["mix_size"]
        target[r["source"]] = r["mix_target"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
    assert len(got) == len(rows) and math.isclose(sum(target.values()), sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] and abs(taken[s] - target[s]) <= 20
    # Weights 1 2 3 1 2 3 by code point, null last: a b c z é null.
    level = target["a"]
    assert all(math.isclose(target[s], min(w * level, 3 * size[s])) for s, w in (("a", 1), ("b", 2), ("c", 3), ("z", 1), ("é", 2), (None, 3)))
    again = sorted((str(r["doc_id"]), r["mix_copies"]) for r in mixing.with_copies(d.repartition(7)).collect())
    assert again == sorted((str(r["doc_id"]), r["mix_copies"]) for r in got)
    mixed = mixing.pareto_mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r["mix_copies"] for r in got)
    assert mixing.with_copies(docs([])).count() == 0
    assert [r["mix_copies"] for r in mixing.with_copies(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_pareto_inclusion_follows_the_rate(docs):
    taken = 0
    for seed in range(6):
        got = mixing.with_copies(docs([(i, "w", None, "a" if i % 2 else "b") for i in range(200)]), seed=seed).where("source = 'b'").collect()
        taken += sum(r["mix_copies"] for r in got)
        assert sum(r["mix_copies"] for r in got) == round(got[0]["mix_target"])
    assert taken


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ODD = ["", " ", "  two  spaces ", "tab\tand\nline \n end ", "don't it's", " a  b", "日本 語", "<|endoftext|> x", "É é", "a" * 5000, "x y " * 3000, None]


def test_token_round_trip(spark, docs, tokenizer):
    from tokenizers import Tokenizer

    from permuta.llm._store import Scratch

    path = Scratch(spark, "tokens").root
    texts = ODD + [prose(EN, RNG.randint(1, 80)) for _ in range(60)]
    order = list(range(len(texts)))
    RNG.shuffle(order)
    d = docs([(i, texts[i]) for i in order] + [(3, "again")]).withColumn("range", F.lit("x")).withColumn("h", F.lit(1))
    token_output.write_tokens(d, path, tokenizer)
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    rows = sorted([(i, t or "") for i, t in enumerate(texts)] + [(3, "again")])
    got = sorted(token_output.read_tokens(spark, path, ids=True).collect(), key=lambda r: (r["doc_id"], r["start"]))
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert r["doc_id"] == i and np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [len(x) for x in token_output.read_document(spark, path, 0)] == [1]
    assert len(token_output.read_document(spark, path, 3)) == 2 and token_output.read_document(spark, path, 10**6) == []


def test_special_tokens_as_the_library_has_them(spark, docs, scratch, tokenizer):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from permuta.llm import registry

    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|> <|endoftext|>", "a  <|endoftext|>  b\n<|endoftext|>", "plain"]
    library = Tokenizer.from_file(tokenizer)
    want = {i: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in enumerate(texts)}
    d = docs(texts)
    d.write.parquet(f"{scratch.root}/documents.parquet")
    for got in (registry.queries()["op6_token_output"](spark, scratch.root), corpus_pipeline.write_ids(spark, d, scratch.root)):
        assert {r["doc_id"]: r["ids_crc32"] for r in got.collect()} == want


def test_token_output_of_an_empty_table(spark, docs, tokenizer):
    from permuta.llm._store import Scratch

    path = Scratch(spark, "tokens").root
    token_output.write_tokens(docs([]), path, tokenizer)
    assert token_output.read_tokens(spark, path).count() == 0


def test_languages(docs):
    rows = [(i, prose(v, RNG.randint(3, 80)), lang) for i, (v, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es")] * 40)]
    d = docs(rows).withColumn("score", F.lit("x"))
    model = language.learn(d.where(~held_out(F.col("doc_id"), 3, 1)))
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = language.identify(d, model).where(held_out(F.col("doc_id"), 3, 1)).collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = language.identify(docs([None, "", "12 !?", "the", "é", "日本", "x " * 20000]), model).collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False, False, False, False]
    none = language.learn(docs([(1, "a", None), (2, None, "en")]))
    assert [r["lang_pred"] for r in language.identify(docs(["a"]), none).collect()] == ["und"]
    one = language.learn(docs([(1, "a b c", "en")]))
    assert [r["lang_pred"] for r in language.identify(docs(["zz"]), one).collect()] == ["en"]
    assert language.identify(docs([]), one).count() == 0


def test_windows_match_brute_force(spark, docs):
    vocabulary = ["a", "b", "c", "né", "42", "word"]
    make = lambda n: " ".join(RNG.choice(vocabulary) + RNG.choice(["", ",", "!", " -"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([1, 2, 5, 9, 10, 11, 14, 30, 30, 12])] + [(50, None), (51, ""), (52, "..."), (8, make(12))]
    rows = [make(RNG.randint(0, 60)) for _ in range(40)]
    rows += [make(20) + " " + t.upper() + " " + make(4) for _, t in items if t] + [None, "", "a" * 4000, make(3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_windows(docs(rows).withColumn("hits", F.lit(1)), bench).collect()
    for r in got:
        assert (r["n_words"], len(r["hits"]), sorted(r["items"])) == hits(rows[r["doc_id"]], items)
    clean = decontaminate.drop_contaminated(docs(rows), bench)
    assert clean.columns == docs(rows).columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(rows) if not hits(t, items)[1]}


def test_windows_in_several_passes(spark, docs, monkeypatch):
    rows = [prose(EN, 60) for _ in range(20)]
    items = [(i, " ".join(rows[i].split()[10:30])) for i in range(0, 20, 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r["doc_id"], r["hits"], r["items"]) for r in decontaminate.find_windows(docs(rows), bench).collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 500)
    assert sorted((r["doc_id"], r["hits"], r["items"]) for r in decontaminate.find_windows(docs(rows), bench).collect()) == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(decontaminate.find_windows(docs(rows), empty)).where("contaminated").count() == 0
    assert decontaminate.find_windows(docs([]), bench).count() == 0


def test_quality_rules(spark, docs):
    good = lambda: prose(EN, RNG.randint(20, 90)).capitalize() + "."
    bad = lambda: RNG.choice([lambda: " ".join(w + "###" for w in prose(EN, 40).split()), lambda: "SHOUT!! " * RNG.randint(10, 60), lambda: "same " * RNG.randint(20, 90)])()
    rows, marks = [], []
    for i in range(300):
        y = int(RNG.random() < 0.7)
        rows.append(good() if y else bad())
        marks.append((i, y, 0))
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(rows).withColumn("stat_upper", F.lit(9)).withColumn("y", F.lit(1)).withColumn("k", F.lit(1))
    model = quality.learn(d.where(~held_out(F.col("doc_id"), 4, 2)), labels)
    got = quality.score(d, model).where(held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(got) > 40 and np.mean([r["predicted"] == marks[r["doc_id"]][1] for r in got]) > 0.95
    assert 0 < len(model.rules) < 120
    odd = quality.score(docs([None, "", "x", "y " * 30000]), model).collect()
    assert odd[0]["score"] == odd[1]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    none = quality.learn(docs([]), labels)
    assert none.rules == [] and quality.score(docs(["a"]), none).count() == 1 and quality.score(docs([]), none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></li></ul></nav><!-- ad --><div class="ad">Buy, now!</div>
<article><h1>A &amp; B</h1><p><b>First  part<br><p>Second
 part, with &lt;tags&gt; &copy; &#233;.</p><form><input>Search</form><section id="comments"><p>I disagree, really.</p></section><p>Ok.</p></article>
<aside>Related things, many of them.</aside><div id="cookie-notice">We use cookies.</div><footer>&copy; site</footer></body></html>"""


def test_page():
    assert extract(PAGE) == "A & B\n\nFirst part\n\nSecond part, with <tags> © é.\n\nOk."
    assert extract("<div><header>Site</header><div id=x><h2>Head</h2><p>Long text, with marks. More of it.</p><p>End</p></div><div class='sidebar'>x</div></div>") == "Head\n\nLong text, with marks. More of it.\n\nEnd"
    assert [extract(x) for x in (None, "", "   ", "<p>", "<!-- x", "<script>x", "plain")] == ["", "", "", "", "", "", "plain"]
    assert extract("<p title='a>b'>x</p>" * 3000).count("x") == 3000


LONG = "Long text, with marks. More of it, and more."


@pytest.mark.parametrize(
    "page",
    [
        f'<div><p title="Hidden Figures">{LONG}</p><p>End.</p></div>',
        f'<div><p><a href="/item?id=related-42">A link</a> {LONG}</p><p>End.</p></div>',
        f'<div><section data-note="a hidden gem"><p>{LONG}</p><p>End.</p></section></div>',
        *[f'<div><div class="{c}"><p>{LONG}</p><p>End.</p></div><div class="sidebar">x</div></div>' for c in ("content no-sidebar", "has-banner", "share-price", "widget")],
        f'<form id="page"><nav><a>Menu</a></nav><article><p>{LONG}</p><p>End.</p></article></form>',
        f'<div class="sidebar"><main><p>{LONG} End.</p></main></div><p>{LONG * 2}</p>',
        f'<article><p>{LONG}</p><p class="hljs-comment">End.</p></article>',
    ],
)
def test_marks_swallow_no_content(page):
    assert LONG in extract(page) and extract(page).endswith("End.")


def test_hidden_parts_and_short_blocks_in_the_body():
    assert extract(f'<div><p>{LONG}</p><p hidden>a</p><p aria-hidden="true">b</p><p style="display: none">c</p></div>') == LONG
    assert extract(f"<body><p>{LONG * 4}</p><ul><li>ok</li></ul><p>{LONG * 4}</p></body>").split("\n\n") == [LONG * 4, "ok", LONG * 4]


def test_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(extract(PAGE)), len(extract(PAGE))]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).columns == ["page_id", "url", "text", "n_chars"]


def test_few_long_texts_keep_rare_counts(docs, scratch, monkeypatch):
    """Words counted more often than the end, but too rare to be held by the tasks."""
    monkeypatch.setattr(hmm, "HELD", 4)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 60) for _ in range(6)]
    got = {r["doc_id"]: r for r in hmm.score_texts(docs(texts), held_out(F.col("doc_id"), 7, 2), scratch).collect()}
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.split(" "), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*t.split(" "), None]
        assert got[i]["n_known"] == sum(x in counts for x in tokens) and got[i]["train_tokens"] == n
        assert abs(got[i]["base_score"] - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)) < 1e-6


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 6, n).astype(np.uint16) for n in (40, 25, 33, 8, 1)]
    model, before = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T), -np.inf
    for _ in range(6):
        now = hmm.forward(model, [s.tobytes() for s in seqs]).sum()
        assert now > before
        before = now
        start, moves, emissions = hmm.expected_counts(model, seqs)
        model = hmm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))


def test_rules_as_a_column_match_rules_row_by_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, len(quality.FEATURES)))
    model = quality.fit_rules(x, (x[:, 0] + 0.5 * x[:, 3] > 0).astype(float))
    names = ["stat_" + f for f in quality.FEATURES]
    got = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *names]).select("i", model.column().alias("s"))
    for r in got.collect():
        z = model.bias
        for weight, rule in model.rules:
            if all((x[r["i"], f] > cut) if above else (x[r["i"], f] <= cut) for f, above, cut in rule):
                z += weight
        assert abs(r["s"] - 1 / (1 + math.exp(-z))) < 1e-9
    assert model.rules


def test_deep_pages_and_links_far_out():
    from permuta.llm.html_extract import blocks, extract

    assert len(extract("<div>x" * 20000)) == 3 * 20000 - 2
    page = blocks("<body><a href=x><b><i><u><s><em>linked words</em></s></u></i></b></a> plain</body>")
    assert [(b.text, b.linked) for b in page.blocks] == [("linked words plain", len("linked words"))]
    assert "x + 1" in extract("<article><p>Let it be <math>x + 1</math>, he said, and so on.</p></article>")


def test_languages_match_votes_row_by_row(docs):
    rng = np.random.default_rng(3)
    words = {"en": "the and with house", "de": "der und mit haus", "nl": "het een met huis", "fr": "le et avec maison", "es": "el y con casa"}
    texts = [" ".join(rng.choice(words[lang].split(), 12)) for lang in words for _ in range(6)]
    model = language.fit(language.features([t.encode() for t in texts]), [lang for lang in words for _ in range(6)])

    def vote(level, classes, margin):
        votes, sums, sure = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 1.0)
        for k, (where, a, b) in enumerate(model.pairs):
            if where == level:
                p = 1 / (1 + np.exp(-np.clip(4 * margin[k], -30, 30)))
                votes[a if margin[k] >= 0 else b] += 1
                sums[a], sums[b] = sums[a] + margin[k], sums[b] - margin[k]
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(classes, key=lambda c: (votes[c], sums[c]))
        return best, sure[best]

    asked = [*texts, "mixed het und casa", "12 + 34", "", None, "maison house huis haus casa"]
    got = [(r["lang_pred"], r["score"]) for r in sorted(language.identify(docs(asked), model).collect(), key=lambda r: r["doc_id"])]
    for text, (lang, score) in zip(asked, got, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        margin = language.features([text.encode()])[0].astype(np.float64) @ model.weights + model.bias
        family, p = vote("", model.families, margin)
        want, q = vote(family, model.languages[family], margin)
        assert lang == want and abs(score - min(p, q)) < 1e-4


def prose(word, n):
    return "".join(f"<p>{word} {i} goes on for a while, and then some. It has two sentences.</p>" for i in range(n))


@pytest.mark.parametrize(
    "mark", ['id="comments"', 'class="widget"', 'class="cookie-bar"', 'class="ad-unit"', 'id="footer_links"', 'class="related-items"', 'role="complementary"', 'class="x sidebar"']
)
@pytest.mark.parametrize("first", [False, True])
def test_boilerplate_longer_than_the_article_goes(mark, first):
    article, other = f'<div id="content"><h1>Title</h1>{prose("Article", 2)}</div>', f"<div {mark}><h2>Beside</h2>{prose('Other', 6)}</div>"
    text = html_extract.extract(f"<html><body>{other + article if first else article + other}</body></html>")
    assert text.count("Article") == 2 and "Title" in text and "Other" not in text and "Beside" not in text


@pytest.mark.parametrize("wrap", ["<form>{}</form>", '<div class="widget">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="sidebar"><div class="search-results">{}</div></div>', '<div class="header-fixed">{}</div>'])
def test_marks_around_the_only_prose_are_taken_back(wrap):
    page = f'<html><body><div class="nav"><a href="/">Home</a> <a href="/x">More of it</a></div>{wrap.format(prose("Article", 3))}<div class="footer">Terms and such, 2024.</div></body></html>'
    text = html_extract.extract(page)
    assert text.count("Article") == 3 and "Home" not in text and "Terms" not in text


def plain_choice(found, spread):
    """The ratios written out: by path the mean length outside links and punctuation, smoothed, multiplied, thresholded."""
    paths = list(dict.fromkeys(b.path for b in found))
    length, marks = [], []
    for p in paths:
        own = [b for b in found if b.path == p]
        length.append(sum(max(0, len(b.text) - b.linked) for b in own) / len(own))
        marks.append(sum(sum(c in ".,;:!?" for c in b.text) for b in own if b.linked < len(b.text) / 2) / len(own))

    def smooth(x):
        if len(x) < 3:
            return x
        near = lambda i: [(math.exp(-0.5 * (i - j) ** 2), x[j]) for j in (i - 1, i, i + 1) if 0 <= j < len(x)]
        return [sum(w * v for w, v in near(i)) / sum(w for w, _ in near(i)) for i in range(len(x))]

    fused = [0 if not n else a * (1 + b) for n, a, b in zip(length, smooth(length), smooth(marks), strict=True)]
    mean = sum(fused) / len(fused)
    level = min(spread * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)) + 1e-9, max(fused))
    chosen = {p for p, f in zip(paths, fused, strict=True) if len(paths) == 1 or f >= level - 1e-12}
    return [i for i, b in enumerate(found) if b.path in chosen]


def random_page(rng):
    """A page of random boilerplate around an article, and the article's blocks."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    sentence = lambda: f"{words(rng.randint(5, 16)).capitalize()}{rng.choice('.!?')}"
    blocks = [f"Title {words(4)}", *[" ".join(sentence() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(2, 9))]]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    holder = rng.choice(['<article>{}</article>', '<div id="content">{}</div>', '<div class="post-body"><div>{}</div></div>', '<main>{}</main>', '<div>{}</div>'])
    links = "".join(f'<li><a href="/{i}">{words(2)}</a></li>' for i in range(rng.randint(3, 12)))
    said = "".join(f"<div><b>{words(1)}</b><p>{sentence()} {sentence()}</p></div>" for _ in range(rng.randint(1, 12)))
    before = [f"<nav><ul>{links}</ul></nav>", f'<div class="menu-bar"><ul>{links}</ul></div>', f'<div class="cookie-bar"><p>{sentence()}</p><button>OK</button></div>', f"<header><h2>{words(2)}</h2></header>"]
    after = [f'<div class="comments-section">{said}</div>', f'<div id="comments">{said}</div>', f'<div class="ad-unit"><p>{sentence()}</p></div>', f'<div class="sidebar"><h3>{words(2)}</h3><ul>{links}</ul></div>', f"<footer><p>{sentence()}</p></footer>", f"<form><p>{words(3)}</p><input></form>"]
    pick = lambda x: "".join(rng.sample(x, rng.randint(0, len(x))))
    return f"<html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{pick(before)}{holder.format(inner)}{pick(after)}<script>x=1;</script></body></html>", blocks


def test_ratios_match_a_plain_form_and_marked_pages_keep_their_article():
    rng = random.Random(7)
    kept = lost = extra = 0
    for _ in range(300):
        page, article = random_page(rng)
        found = html_extract.blocks(page).blocks
        assert html_extract.chosen_blocks(found) == plain_choice(found, 0.5)
        got = html_extract.extract(page).split("\n\n")
        kept += sum(len(b) for b in article if b in got)
        lost += sum(len(b) for b in article if b not in got)
        extra += sum(len(b) for b in got if b not in article)
    print(f"kept {kept / (kept + lost):.4f} of the articles, {extra / (kept + lost):.4f} beside them")
    assert lost < 0.02 * kept and extra < 0.02 * kept
