"""Each operator against a plain version, on texts with nulls, blanks, ties, repeats and clashing columns."""

import base64
import hashlib
import json
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tidemark.llm import bpe, common, embeddings, html_text, language_model, packing, quality_rules, sharding, similar, simhash, token_counts, weak_label

SCHEMA = "doc_id long, text string, component_id long, kept boolean, size long, _words string"


def texts():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)] + ["the", "of", "and", "la", "de", "É", "ñandú"]
    out = [None, "", " \n\t", "one", "two words", "ΣΑΣ İx 😀 ...", "don't we'll 1234 !!", "a" * 5000, "x y " * 4000, "<|endoftext|> the"]
    out += [" ".join(rng.choice(words, int(n))) for n in rng.integers(20, 400, 40)]
    out += [out[20]] * 3 + [out[25] + " tail"] + ["\n".join(["same line of the text"] * 9 + [out[30]])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 1, True, 2, "z") for k, t in enumerate(texts())] + [(None, "no id", 1, False, 0, None), (7, "a" * 5000, 1, True, 2, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is None, v) for v in x)


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=1>menu</a></nav><div class='sidebar'><p>side</p></div><article><h1>A &amp; B</h1><p>One <b>two</b>three<br>four<p>five<script>var a='</p>'</script><form>f</form><div class='comments'><p>reader</p></div></article><footer>x</footer>"
    assert html_text.extract(page) == "A & B One twothree four five"
    assert [html_text.extract(x) for x in (None, "", "  ", "<html></html>", "<nav>a</nav>")] == [""] * 5
    assert html_text.extract("plain &lt;text&gt;\n here") == "plain <text> here"
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    plain = "<body><div id=menu><ul>" + "<li><a href=x>go</a>" * 30 + "</ul></div><div id=main><p>" + "</p><p>".join(["long text of the story"] * 6) + "</p></div></body>"
    assert html_text.extract(plain) == " ".join(["long text of the story"] * 6)


def test_html_density_as_written_out():
    """Counts, densities, sums and the core of random trees, each by the definition from the node alone."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        source = "<body>"
        for _ in range(60):
            source += rng.choice(["<div>", "<p>", "</div>", "<a href=x>go on</a>", "<section>", "</section>", "some words here ", "a longer stretch of text, with commas, " * 3, "<b>bold</b>", "<br>"])
        top = html_text.parse(source)
        nodes = html_text.walk(top)
        html_text.weigh(nodes)

        def below(x):
            return [y for c in x.items if isinstance(c, html_text.Node) for y in (c, *below(c))]

        def chars(x):
            return sum(len("".join(c.split())) if isinstance(c, str) else chars(c) for c in x.items)

        def density(x):
            own = [y for y in below(x) if y.tag != "br"]
            links = [y for y in own if y.tag == "a"]
            in_links = chars(x) if x.tag == "a" else sum(map(chars, links))
            share = sum(chars(y) for y in below(top) if y.tag == "a") / max(1, chars(top))
            return html_text.composite(chars(x), len(own), in_links, len(links), share)

        totals = [sum(density(c) for c in x.items if isinstance(c, html_text.Node)) for x in nodes]
        assert np.allclose([x.density for x in nodes], [density(x) for x in nodes]) and np.allclose([x.total for x in nodes], totals)
        if max(totals):
            assert html_text.core(nodes) is nodes[int(np.argmax(np.round(totals, 9)))]


def test_html_by_density_alone():
    story = [f"paragraph {k} of a story that goes on for quite some words, as stories do when told at length" for k in range(8)]
    links = "<div><ul>" + "<li><a href=x>go here</a>" * 20 + "</ul></div>"
    first, second = ("".join(f"<p>{t}</p>" for t in part) for part in (story[:5], story[5:]))
    page = f"<body>{links}<div>We use biscuits.</div><div><h1>Title</h1><div>{first}</div><div>{links}</div><div>{second}</div></div><div>Bob: no.</div>{links}</body>"
    assert html_text.extract(page) == " ".join(["Title", *story])  # the second part hangs on the path and reaches the threshold
    nodes = html_text.walk(html_text.parse(page))
    html_text.weigh(nodes)
    best = html_text.core(nodes)
    assert best.tag == "div" and best.chars == sum(len(t.replace(" ", "")) for t in story[:5])


@pytest.mark.parametrize("named", ['class="content has-sidebar"', 'class="post-content social-enabled"', 'class="hentry post comments-open"', 'class="article-body with-comments"', 'class="page-wrap header-fixed"', 'class="wrapper footer-sticky"', 'class="entry hidden-print"', 'id="content-side-by-side"', "class=sidebar"])
def test_html_class_is_weak_evidence(named):
    story = [f"paragraph {k} of a story that goes on for quite some words" for k in range(6)]
    page = f"<body><div class=menu><a href=x>a</a></div><div {named}>" + "".join(f"<p>{t}</p>" for t in story) + "</div><div class='comment-list'><p>reader says no</p></div><div class=ad>Buy!</div></body>"
    assert html_text.extract(page) == " ".join(story)


def test_html_broken_and_deep_pages():
    assert html_text.extract("<body><p title=it's>one two</p><p>it's three</p></body>") == "one two it's three"
    assert html_text.extract("<p data-class=ad title='a>b' x=\"c>d\">kept<!--> and this --></p>") == "kept and this -->"
    for page in ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "<div><i>" + "<span>" * 50_000 + "deep" + "</div></i>" * 50_000, "<b>" * 100_000 + "deep" + "</i>" * 100_000):
        start = time.perf_counter()
        assert html_text.extract(page) == "deep" and time.perf_counter() - start < 10


def test_html_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    data = [(1, "u", "<p>a  b</p>", "x", "y"), (1, "u", "<p>a  b</p>", "x", "y"), (None, None, "<p>c</p>", None, None), (3, "v", None, "x", "y"), (4, "w", " ", "x", "y"), (5, "z", "<p>é&amp;" + "w " * 700_000, "x", "y")]
    got = html_text.main_text(spark.createDataFrame(data, schema).repartition(2)).collect()
    want = [(i, u, html_text.extract(h), len(html_text.extract(h))) for i, u, h, *_ in data]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and want[5][3] == 1_400_001 and want[3][2] == ""
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []


def test_simhash(spark, docs, none):
    def plain(t):
        w = regex.findall(rb"[^\x20\x09-\x0d]+", t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    own = rows(docs)
    prints = [plain(t) for _, t in own]
    group = list(range(len(own)))
    for _ in own:
        group = [min(group[j] for j in range(len(own)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(own))]
    least = {g: min((own[i][0] for i in range(len(own)) if group[i] == g and own[i][0] is not None), default=None) for g in group}
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=key) == sorted(((own[i][0], prints[i], least[group[i]]) for i in range(len(own))), key=key)
    assert simhash.near_duplicates(none).collect() == []


def test_vantage_tree_finds_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64) for _ in range(4)]
    points = np.unique(np.concatenate([base, rng.choice(base, 1500) ^ flips[0] ^ flips[1] ^ flips[2], rng.integers(0, 2**63, 4000, dtype=np.uint64), base[0] ^ flips[0] ^ flips[1] ^ flips[2] ^ flips[3]]))
    for rows_ in (200, 2000):
        tree = simhash.VantageTree(points[:3000], len(points), rows_)
        at, shard = tree.route(points)
        meet = {(a, b) for s in np.unique(shard) for x in [at[shard == s]] for a, b in np.argwhere(np.triu(np.bitwise_count(points[x][:, None] ^ points[x][None, :]) <= 3, 1)) for a, b in [sorted((x[a], x[b]))]}
        assert meet == {tuple(x) for x in np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))}
    parts = dict(p for m, r in simhash.local_parts(points) for p in zip(m.tolist(), r.tolist(), strict=True))
    dense = simhash.flood(points, 3)
    assert set(parts) == {int(v) for m, _ in dense for v in m}


def test_vantage_tree_splits_real_fingerprints():
    found = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    points = np.unique(np.array([simhash.fingerprint(t) for t in found], np.int64)).view(np.uint64)
    assert simhash.VantageTree(points, len(points), simhash.SHARD_ROWS).depth >= 1
    for total in (15_000_000, 1_500_000_000):
        tree = simhash.VantageTree(points, total, max(simhash.SHARD_ROWS, total // simhash.LEAVES))
        at, _ = tree.route(points)
        assert len(at) < 25 * len(points) and tree.depth > 20
    assert simhash.split(points, 3, np.random.default_rng(1), simhash.Costs(points, simhash.LEAF, len(points), 3, np.random.default_rng(1)))


def test_token_counts(docs, none):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    name = {v: k for k, v in token_counts.byte_symbols().items()}

    def greedy(word):
        s = [name[b] for b in word.encode()]
        s[-1] += "</w>"
        i = n = 0
        while i < len(s):
            i = next(j for j in range(min(len(s), i + 40), i, -1) if "".join(s[i:j]) in vocabulary)
            n += 1
        return n

    got = sorted(((r.doc_id, r.n_chars, r.n_tokens, r.n_words) for r in token_counts.token_counts(docs).collect()), key=key)
    want = []
    for i, t in rows(docs):
        words = regex.findall(token_counts._words.pattern, "".join(c.lower() for c in t))
        want.append((i, len(t), sum(map(greedy, words)), len(words)))
    assert got == sorted(want, key=key) and token_counts.token_counts(none).collect() == []


def test_quality_rules(docs, none):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    got = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words").collect()
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(quality_rules.ORACLE_SQL).fetchall(), key=key)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got) and quality_rules.judge(none).collect() == []


def test_language_model(docs, none):
    rng = np.random.default_rng(0)
    model = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in language_model.fresh().items()}
    text = np.array([5, 70, 4000], np.int32)
    total = 0.0
    for token in range(language_model.SIZE):  # conditional probabilities of the middle token sum to one
        total += np.exp(language_model.step(model, language_model.joined([np.array([5, token, 4000], np.int32)]), np.array([language_model.REACH + 1]))[0])
    assert abs(total - 1) < 1e-3
    assert np.isclose(language_model.log_likelihood(model, [text, text])[1], language_model.log_likelihood(model, [text])[0], atol=1e-4)
    frequent, trained, _ = language_model.train(docs)
    got = language_model.score(docs, frequent, trained).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and by[0].n_tokens == 0 and by[0].log_likelihood == 0 and by[8].n_tokens == 8000
    fresh = {r.doc_id: r for r in language_model.score(docs, frequent, language_model.fresh()).collect()}
    assert sum(r.log_likelihood for r in got) > sum(fresh[r.doc_id].log_likelihood for r in got)
    frequent, trained, dealt = language_model.train(none)
    assert language_model.score(none, frequent, trained).collect() == language_model.score_coded(dealt, trained).collect() == []


def test_language_model_scores_as_written_out(spark):
    """Every conditional probability by the definition, one token and one id at a time."""
    rng = np.random.default_rng(3)
    m = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in language_model.fresh().items()}
    sample = ["the cat saw the dog", "dog", "the the zebra of cat cat saw"]
    frequent = ["the", "cat", "dog", "saw", "of"]
    words = language_model.Words(frequent)
    far, want = language_model.REACH, []
    for t in sample:
        ids = [language_model.SIZE] * far + [words.id(w) for w in t.split()] + [language_model.SIZE] * far
        total = 0.0
        for i in range(far, len(ids) - far):
            near = [*range(i - far, i), *range(i + 1, i + far + 1)]
            hidden = np.append(sum(m["in"][ids[j]].astype(float) * m["at"][k] for k, j in enumerate(near)), 1.0)
            score = np.array([np.exp(m["class"][x % language_model.CLASSES] @ hidden) for x in range(language_model.CLASSES)])
            c = ids[i] % language_model.CLASSES
            member = np.exp(m["member"][c] @ hidden)
            total += np.log(score[c] / score.sum()) + np.log(member[ids[i] // language_model.CLASSES] / member.sum())
        want.append(total)
    got = language_model.score(spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string"), frequent, m).collect()
    assert np.allclose([r.log_likelihood for r in sorted(got)], want, atol=1e-3)


def test_language_model_of_the_whole_corpus(spark):
    """The same rows in 4 and in 64 partitions give one model, better than the table of word frequencies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    nats, scores = [], []
    for n in (4, 64):
        frequent, model, dealt = language_model.train(docs.repartition(n, "doc_id"), stream_tokens=1 << 14)  # 6 streams
        got = {r.doc_id: r for r in language_model.score(docs, frequent, model).collect()}
        assert all(np.isclose(got[r.doc_id].log_likelihood, r.log_likelihood, rtol=1e-4) for r in language_model.score_coded(dealt, model).collect())
        scores.append([got[k].mean_log_likelihood for k in sorted(got)])
        nats.append(-sum(r.log_likelihood for r in got.values()) / sum(r.n_tokens for r in got.values()))
    counts = language_model.vocabulary(docs)[1]
    words = -(counts[counts > 0] / counts.sum()) @ np.log(counts[counts > 0] / counts.sum())
    assert max(nats) < words - 0.3 and abs(nats[0] - nats[1]) < 0.01 and np.abs(np.subtract(*scores)).max() < 0.05


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for i, t in rows(docs):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    got = packing.pack(packing.pieces(docs, 256), 256).toPandas()
    assert sorted(((None if i != i else int(i), *map(int, x)) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)), key=key) == sorted(want, key=key)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 1
    assert packing.sequences(docs, 256).count() == got["sequence_id"].nunique()
    assert packing.pack(packing.pieces(none)).collect() == []


def test_packing_of_one_length_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 50)
    same = spark.range(1000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one two' AS text")
    got = packing.pack(packing.pieces(same, 10), 10).toPandas()
    assert len(got) == 1000 and got["sequence_id"].nunique() == 334
    assert all(sorted(g["offset"]) == list(range(0, 3 * len(g), 3)) for _, g in got.groupby("sequence_id"))


def test_token_ids_as_by_the_tokenizer():
    rng = np.random.default_rng(6)
    letters = list("aAzZéÉßİıſẞŒøŁΣσςΑάДжकाไ漢字ｆ한가가\u0301\u0307\u0327\u200b\u00adª²½٣Ⅷ😀.,.,.,!?'’-_#<|>") + [" ", "  ", "\n", "\t", "\u3000", "\x85", "<|endoftext|>", "<|StartOfText|>", "'LL", "TBMMSİ."]
    found = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 12, 20_000)] + ["TBMMSİ. ok", "<|endoftext|> the", "a<|startoftext|>b", "<|ENDOFTEXT|>"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.Cutter(public_tokenizers.path(packing.VOCABULARY)).ids(pa.array(found))
    wrong = [t for t, x, e in zip(found, got, tokenizer.encode_batch(found, add_special_tokens=False), strict=True) if x.tolist() != e.ids]
    assert wrong == []


def test_fullest_combination():
    rng = np.random.default_rng(3)
    for _ in range(200):
        left = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 120))
        found = packing.fullest(left, room)
        sums = {0}
        for k, n in left.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room) and all(left[k] >= n for k, n in found.items())


def test_bpe(docs, none):
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows(docs):
        ids = plain.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=key) == sorted(want, key=key) and bpe.round_trip(none).collect() == []
    for t in ("ab 12 !? " * 30_000, " " * 9000 + "x", "x" + "\n" * 9000, "w" * 70_000 + "　" * 9000 + "'s 1", "a'b1!c " * 12_000 + " " * 70_000 + "end"):
        assert bpe.encode(plain, t).tolist() == plain.encode_ordinary(t)
    tokens = bpe.encoded(docs)
    assert {(r.doc_id, bytes(r.content)) for r in bpe.decoded(tokens).collect()} == {(i, t.encode()) for i, t in rows(docs)}


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, 5).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == docs.count() and counts.max() - counts.min() <= 1 and len(counts) == 5
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    own = [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows(docs)]
    assert sorted(((None if i != i else int(i), int(s), int(c)) for i, s, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)), key=key) == sorted(own, key=key)
    hot = spark.range(1000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'x' AS text")
    counts = sharding.shard(hot, 7).groupBy("shard").count().toPandas()["count"]
    assert counts.max() - counts.min() <= 1 and sharding.shard(none).collect() == []


def test_sharding_starts_at_the_next_point(spark):
    """Without a bound that binds, every key is at the first point clockwise from its hash; one arc in parts, too."""
    ids = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "xxhash64(id) AS h")
    at = {r.doc_id: r.h for r in ids.collect()}
    got = {r.doc_id: r.shard for r in sharding.shard(ids.drop("h"), 3).collect()}
    points = sharding.ring(3)
    first = {i: next((s for p, s in points if p >= h), points[0][1]) for i, h in at.items()}
    moved = sum(first[i] != got[i] for i in at)
    count = [sum(s == k for s in first.values()) for k in range(3)]
    assert moved >= sum(max(0, c - 1000) for c in count) and moved < 1500
    assert all(got[i] == s for i, s in first.items() if count[s] <= 1000)
    parts = sharding.SALT_ROWS
    sharding.SALT_ROWS = 100
    try:
        hot = sharding.shard(spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'x' AS text"), 7).toPandas()
    finally:
        sharding.SALT_ROWS = parts
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in hot.groupby("shard")) and hot.groupby("shard").size().between(285, 286).all()


def test_flow_is_clockwise():
    counts, owners = [5, 0, 3, 1], [0, 1, 2, 1]
    spans = sharding.flow(counts, owners, 3)
    place = {(a, r): s for a, lo, hi, s, _ in spans for r in range(lo, hi)}
    room, load = [3, 3, 3], [0, 0, 0]
    want = {}
    waiting = [(a, r, a) for a, c in enumerate(counts) for r in range(c)]
    while waiting:
        later = []
        for a, r, at in waiting:
            s = owners[at]
            if load[s] < room[s]:
                load[s] += 1
                want[a, r] = s
            else:
                later.append((a, r, (at + 1) % 4))
        waiting = later
    assert place == want


def test_embeddings(spark, none):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 64))
    x = [*base, *(base[3] + rng.normal(size=(40, 64)) * 0.15), *(base[:30] + rng.normal(size=(30, 64)) * 0.4), base[7], base[7], base[7] * 3]
    data = [(k, [float(v) for v in e], 1) for k, e in enumerate(x)] + [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 2), (903, [None] + [1.0] * 63, 2), (904, [1.0], 1), (905, [], 1), (None, [1.0] + [0.0] * 63, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, kept int"), bucket_rows=8, bucket_cap=16).toPandas().set_index("vec_id")
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    found = got.loc[range(len(x)), "n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert (got.loc[[900, 901, 902, 903, 904, 905], "n_links"] == 0).all() and got.loc[900, "component_id"] == 900
    exact = [7, len(x) - 3, len(x) - 2, len(x) - 1]
    assert set(got.loc[exact, "component_id"]) == {7} and len(got) == len(data)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_embeddings_meet_at_any_total():
    rng = np.random.default_rng(9)
    x = embeddings.unit(rng.normal(size=(6000, 64)))
    side = rng.normal(size=x.shape)
    side = embeddings.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side
    learned = [embeddings.learn(x[:3000], 64, 5 + k) for k in range(8)]
    a, b = embeddings.codes(x, learned), embeddings.codes(y, learned)
    for total in (2_000, 20_000, 50_000, 200_000, 1_000_000, 10_000_000, 100_000_000):  # bands of up to 20 bits
        assert embeddings.met(a, b, embeddings.bands(total, 64)).mean() >= 0.98


@pytest.mark.parametrize("caps", [{}, {"bucket_cap": 40, "sifted_cap": 7}])
def test_embeddings_as_brute_force(spark, caps):
    """n_links, component_id and kept, for groups of copies, chains of links and three lengths of vectors."""
    rng = np.random.default_rng(13)
    x = []
    for dim, n in ((64, 400), (16, 60), (2, 8)):
        base = rng.normal(size=(n, dim))
        x += [*base, *(base[:40] + rng.normal(size=base[:40].shape) * 0.2), *(base[1] + rng.normal(size=(30, dim)) * 0.2), *([base[2]] * 5)]
    links = np.array([[len(a) == len(b) and a @ b >= 0.9 * np.sqrt((a @ a) * (b @ b)) for b in x] for a in x])
    group = np.arange(len(x))
    while ((new := np.where(links, group, len(x)).min(1)) != group).any():
        group = new
    data = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, embeddings.near_duplicates(data, **caps).collect()))
    assert got == [(k, int(links[k].sum()) - 1, int(g), k == g) for k, g in enumerate(group)]


def test_embeddings_of_wide_bands(spark):
    rng = np.random.default_rng(10)
    base = embeddings.unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=base.shape)
    side = embeddings.unit(side - (side * base).sum(1, keepdims=True) * base)
    x = np.concatenate([base, 0.901 * base + np.sqrt(1 - 0.901**2) * side])
    links = (x @ x.T >= 0.9).sum() - len(x)
    data = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(data, bucket_rows=0.01).toPandas()  # bands of 16 bits, as for millions of vectors
    assert 0.98 * links <= got["n_links"].sum() <= links


def test_weak_label(spark, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, report = weak_label.train(docs)
    both = weak_label.score(docs, weights).join(labels, "doc_id").toPandas()
    assert (both["kept"] == (both["quality"] == 1)).mean() > 0.93 and both[both["quality"] == 1]["kept"].mean() > 0.98
    assert set(report["accuracy"]) == {x[0] for x in weak_label.LABELLERS}
    assert weak_label.score(none, weak_label.train(none)[0]).collect() == []


def test_weak_label_keeps_order_and_columns(docs):
    kept = weak_label.keep(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = c.quality_rules_stage(spark, docs, sf)
    second = c.quality_classifier_stage(spark, first, sf)
    third = c.near_duplicates_stage(spark, second, sf)
    assert first.columns == second.columns == third.columns == docs.columns
    left = second.orderBy("doc_id").select("doc_id", "text").collect()
    group, _ = five_word_components([r.text for r in left])
    assert sorted(r.doc_id for r in third.select("doc_id").collect()) == sorted({left[g].doc_id for g in group})
    packed = c.packing_stage(spark, third, sf).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in third.collect()} and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert c.run(spark, sf).select("doc_id").distinct().count() == third.count()


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://there:7077"
        _jsc = type("J", (), {"sc": lambda self: self, "getCheckpointDir": lambda self: self, "isDefined": lambda self: False})()
        getConf = staticmethod(dict)

    frame = type("Frame", (), {"sparkSession": type("Session", (), {"sparkContext": Context()})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(frame)


def near_copies():
    """Texts with copies of every similarity about 0.8, by words changed here and there."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{k}" for k in range(3000)])
    out = [None, " ", "one two", "One  TWO"]
    for n in rng.integers(60, 500, 60):
        own = rng.choice(words, n)
        out.append(" ".join(own))
        for share in (0.01, 0.02, 0.025, 0.03):
            changed = own.copy()
            at = rng.choice(n, max(1, int(share * n)), replace=False)
            changed[at] = rng.choice(words, len(at))
            out.append(" ".join(changed))
    return out


def five_word_components(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(sets)))
    linked = [[j for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    while (new := [min(group[j] for j in links) for links in linked]) != group:
        group = new
    return group, sum(map(len, linked))


def test_near_duplicates_by_five_words(spark):
    import corpus_pipeline as c

    texts = near_copies()
    group, links = five_word_components(texts)
    assert links > 2 * len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in c.near_duplicates_stage(spark, docs, "").collect()) == sorted(set(group))


def test_near_duplicates_without_good_ids(spark):
    import corpus_pipeline as c

    texts = [t for t in near_copies() if t]
    group, _ = five_word_components(texts)
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True)] + [(None, texts[0])] * 3 + [(7, texts[1])], "doc_id long, text string").repartition(5)
    kept = c.near_duplicates_stage(spark, docs, "").collect()
    by = {t: g for t, g in zip(texts, group, strict=True)}
    assert len(kept) == len(set(group)) == len({by[r.text] for r in kept})
    for r in kept:
        own = [i for i, g in zip(ids, group, strict=True) if g == by[r.text] and i is not None]
        assert r.doc_id == min(own, default=None)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert c.near_duplicates_stage(spark, empty, "").collect() == []


def test_near_duplicates_through_trees_of_fingerprints(spark, monkeypatch):
    import corpus_pipeline as c

    seen = []

    def tree(*given):
        seen.append(simhash.VantageTree(*given))
        return seen[-1]

    monkeypatch.setattr(similar, "VantageTree", tree)
    monkeypatch.setattr(similar, "SHARD_ROWS", 64)
    texts = near_copies()
    group, _ = five_word_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in c.near_duplicates_stage(spark, docs, "").collect()) == sorted(set(group))
    assert len(seen) == similar.TREES and all(t.reach == 1 and t.shards > 1 for t in seen)


def test_leaf_links_as_brute_force(monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 32)
    rng = np.random.default_rng(4)
    rec = np.zeros(1500, similar.RECORD)
    rec["node"], rec["fp"] = np.arange(1500), rng.integers(0, 2**16, 1500)
    rec["check"] = rng.integers(0, 2**63, (1500, similar.CHECK))
    rec["fp"][700:900], rec["check"][700:900] = 77, rec["check"][700]  # dense
    for k in range(1000, 1400):  # chains, each a bit or two from the one before it
        rec["fp"][k] = rec["fp"][k - 1] ^ (1 << rng.integers(16)) ^ ((1 << rng.integers(16)) if k % 7 == 0 else 0)
        rec["check"][k] = rec["check"][k - 1] ^ np.uint64(0x0F << rng.integers(40))
    close = np.bitwise_count(rec["fp"][:, None] ^ rec["fp"]) <= 1
    close &= np.bitwise_count(rec["check"][:, None] ^ rec["check"]).sum(2) <= similar.FAR
    costs = simhash.Costs(rec["fp"].astype(np.uint64), 32, 1500, 1, rng)
    a, b = similar.leaf_links(rec, costs)
    assert close[a, b].sum() >= 400
    got = simhash.forest(a, b, np.arange(1500))
    assert (got == simhash.min_label(close)).all()
    tree = simhash.VantageTree(rec["fp"].astype(np.uint64), 1500, 64, 1)
    at, shard = tree.route(rec["fp"].astype(np.uint64))
    own = np.zeros((1500, tree.shards), bool)
    own[at, shard] = True
    i, j = np.nonzero(np.bitwise_count(rec["fp"][:, None] ^ rec["fp"]) <= 1)
    assert tree.shards > 8 and (own[i] & own[j]).any(1).all()


def test_pairs_at_the_least_similarity_meet_in_a_tree():
    rng = np.random.default_rng(6)
    missed = 0
    for n in rng.integers(20, 400, 1500) // 9 * 9 + 9:
        pool = rng.integers(0, 2**63, n * 10 // 9, dtype=np.uint64)
        a, b = (similar.signature(np.sort(x)) for x in (pool[:n], pool[len(pool) - n :]))  # of n + n / 9 eight ninths of n are in both
        meet = (np.bitwise_count(a.view(np.uint16) ^ b.view(np.uint16)) <= 1).any()
        missed += not (meet and np.bitwise_count(a ^ b)[: similar.CHECK].sum() <= similar.FAR)
    assert missed <= 3
