"""Operators and pipeline stages against brute force, on planted cases and on awkward input."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan.llm import chat_format, decontaminate, html_text, line_dedup, lm_score, near_dedup, quality_rules, queries, source_mix, token_count, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 900}x{i // 900}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one two", "x" * 5000, long, long, "Ünïcode " * 60, "<b>&[INST]</s>\n\n" * 20]
    rows = [(i, t, None if i % 2 else "s") for i, t in enumerate(texts)]
    rows += [(3, "one two", None), (None, "no id at all", "s"), (None, None, None), rows[5]]
    return frame(spark, rows).withColumns({"score": F.lit("mine"), "n_lines": F.lit(7), "slot": F.lit(1)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        mine = queries.QUERIES[name](spark, DATA)
        columns = sorted(mine.columns)
        got = sorted(map(str, (tuple(r[c] for c in columns) for r in mine.collect())))
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert got == sorted(map(str, want)), name


def test_every_operator_takes_awkward_and_empty_input(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "one two three four five six"), (4, "one two three four five six")], "item_id long, text string")
    for docs in (awkward, nothing):
        n = docs.count()
        assert line_dedup.dedup_lines(docs).count() == n
        assert quality_rules.score_quality(docs).count() == n
        assert token_count.count_tokens(docs).count() == n
        assert decontaminate.find_contamination(docs, bench).count() == 0
        assert decontaminate.drop_contaminated(docs, bench).count() == n
        assert source_mix.mix_sources(docs).count() == n
        assert lm_score.score_documents(docs).count() == n
        assert toxicity.score_toxicity(docs, None).where("score = 0").count() == n
        assert near_dedup.near_duplicates(docs).count() == n
    kept = {(r["doc_id"], r["text"]) for r in near_dedup.keep_one(awkward).collect()}
    assert (5, awkward.where("doc_id = 5").first()["text"]) in kept and not any(i == 6 for i, _ in kept)
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_text(pages).collect()] == ["", "", "a"]


def test_pipeline_stages(spark, awkward, nothing):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, DATA)
            if name != "source_mix":
                assert docs.columns == columns, name
        docs.collect()
    assert corpus_pipeline.run(spark, DATA).count() > 50


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"line{i}word{j}" for j in range(6)) for i in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice([s, s.upper(), f"  {s}\t"]) for s in rng.choices(pool, k=rng.randint(0, 6))] + [f"own line of document number {i} and nothing else"] * rng.randint(0, 2) + ["short"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "s"))
    holders: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t, _ in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])) for i, t, _ in rows}
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and sum(r["n_dropped"] for r in got) > 20


def test_token_counts_brute_force(spark):
    pieces = token_count.load_pieces(token_count.TOKENIZER)
    floor = min(pieces.values()) - 10

    def best(word):
        text = token_count.MARK + word
        state = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(state[end - 1][0] + size * floor, state[end - 1][1] + size)]
            options += [(state[s][0] + pieces[text[s:end]], state[s][1] + 1) for s in range(end) if text[s:end] in pieces]
            state.append(max(options, key=lambda o: (o[0], -o[1])))
        return state[-1][1]

    texts = ["The quick brown foxes unbelievably jumped", "naïve 漢字 ☃ words\nand\tlines", "", None, "aaaa aaab aaaab"]
    want = [0 if t is None else sum(best(w) for w in t.split()) + len(re.findall(r"[\t\n]", t)) for t in texts]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for nodes in (1_000, 5):
        got = token_count.count_tokens(docs, max_nodes=nodes).orderBy("doc_id").collect()
        assert [r["n_tokens"] for r in got] == want


def test_contamination_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    items = [" ".join(rng.choices(words, k=n)) for n in (40, 40, 15, 7, 4)]
    docs, truth = [], set()
    for i in range(60):
        filler = rng.choices(words, k=rng.randint(0, 300))
        if i % 3 == 0:
            item = i // 3 % 4
            part = items[item].split()
            if i % 2 and len(part) > 20:  # one word in eight replaced, and other case and punctuation
                part = [w if k % 8 else "zzz" for k, w in enumerate(part)]
                part = [w.upper() + "," for w in part]
            filler[len(filler) // 2 : len(filler) // 2] = part
            truth.add((i, item))
        docs.append((i, " ".join(filler), "s"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, docs), bench).collect()}
    assert left == {i for i in range(60)} - {i for i, _ in truth}


def test_chat_examples_and_round_trip(spark):
    rows = [(1, 0, "system", "be & <kind> [x]"), (1, 1, "user", "hi <|im_end|>\n"), (1, 2, "assistant", "&amp;"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (3, 1, "assistant", "only"), (None, None, None, None), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.format_conversations(given)
    for r in examples.collect():
        assert r["prompt_chars"] == len(r["prompt"]) and r["target_chars"] == len(r["target"] or "")
        assert "[" not in r["prompt"] and r["prompt"].count("<") == r["prompt"].count("<|im_")
    assert sorted((r["conv_id"], r["example"]) for r in examples.where("trainable and conv_id is not null").collect()) == [(1, 2), (1, 4), (3, 0), (4, 0), (4, 1)]
    back = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert back[1]["turns_sha256"] == sha("".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)) and back[1]["loss_sha256"] == sha("&amp;") and back[1]["n_turns"] == 6
    assert back[2]["loss_chars"] == 0 and back[4]["loss_sha256"] == sha("aa") and back[None]["turns_sha256"] == sha("\n\n")


def lags(schedule, weights):
    """Largest deviation of a source from its target over all prefixes of the slots."""
    total, at = sum(weights.values()), np.array([list(weights).index(s) for s in schedule])
    worst = 0
    for k, w in enumerate(weights.values()):
        ran = np.cumsum(at == k)
        # In whole numbers: total * blocks - slots * weight, over the total.
        worst = max(worst, int(np.abs(total * ran - w * np.arange(1, len(at) + 1)).max()))
    return worst / total


def test_pfair_by_brute_force():
    """The schedule against one that looks at all sources in every slot."""
    rng = random.Random(5)
    for _ in range(60):
        names = "abcdefg"[: rng.randint(1, 7)]
        weights, blocks = {s: rng.choice([1, 2, rng.randint(1, 60)]) for s in names}, {s: rng.randint(0, 30) for s in names}
        left, start, want, first = {s: n for s, n in blocks.items() if n}, 0, [], True
        while left:
            total, ran = sum(weights[s] for s in left), dict.fromkeys(left, 0)
            slot = 0
            while True:
                due, s = min((-(-(n + 1) * total // weights[s]), s) for s, n in ran.items() if n * total // weights[s] <= slot)
                if ran[s] == left[s]:
                    break
                assert ran[s] * total // weights[s] <= slot < due
                want.append((s, blocks[s] - left[s] + ran[s], start + ran[s] * total // weights[s], start + due, start + slot, first))
                ran[s] += 1
                slot += 1
            left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}
            start, first = start + slot, False
        assert list(source_mix.pfair(weights, blocks)) == want and len(want) == sum(blocks.values())


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2, "c": 0.0004}, {"a": 0.1, "b": 0.2, "c": 0.7}, {"a": 1 / 3, "b": 3**0.5, "c": 1e-7}, {"a": 5}])
def test_a_million_slots_stay_within_a_block_of_the_given_weights(weights):
    whole = source_mix.whole_weights(weights)
    assert all(whole[s] / whole["a"] == pytest.approx(w / weights["a"]) for s, w in weights.items())
    endless = {s: 10**7 for s in weights}
    slots = [s for (s, *_), _ in zip(source_mix.pfair(whole, endless), range(10**6))]
    if sum(whole.values()) < 2**40:
        assert lags(slots, whole) < 1
    total, done = sum(whole.values()), Counter()
    for t, s in enumerate(slots, 1):
        done[s] += 1
        if t % 9973 == 0 or t == len(slots):
            assert all(abs(total * done[x] - t * c) < total for x, c in whole.items())


def test_mix_of_documents(spark):
    rows = [(i, f"t{i}", "abcd"[i % 4] if i % 3 else "a") for i in range(700)]
    weights = {"a": 4, "b": 1, "c": 1, "d": 2.5}
    got = source_mix.mix_sources(frame(spark, rows), weights, block_docs=4).collect()
    assert len(got) == 700 and len({(r["slot"], r["offset"]) for r in got}) == 700
    taken = {r["slot"]: r["source"] for r in got}
    counts = Counter(s for *_, s in rows)
    assert sorted(taken) == list(range(sum(-(-n // 4) for n in counts.values())))  # every slot, one source each
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    end = 1 + max(r["slot"] for r in got if r["in_mix"])
    assert lags([taken[t] for t in range(end)], {s: int(2 * w) for s, w in weights.items()}) < 1 and any(not r["in_mix"] for r in got)
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError, match="positive"):
            source_mix.mix_sources(frame(spark, rows), {"a": bad})
    small = source_mix.mix_sources(frame(spark, rows), weights, block_docs=4, bucket_rows=3).collect()  # blocks over several buckets
    assert sorted((r["doc_id"], r["block"], r["offset"], r["slot"]) for r in small) == sorted((r["doc_id"], r["block"], r["offset"], r["slot"]) for r in got)


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "MAX_BLOCKS", 30)
    rows = [(i, f"t{i}", "ab"[i % 2]) for i in range(200)]
    got = source_mix.mix_sources(frame(spark, rows), {"a": 1, "b": 1}, block_docs=2).collect()
    assert len(got) == 200 and max(r["offset"] for r in got) == 7 and {r["slot"] for r in got} == set(range(26))
    monkeypatch.setattr(source_mix, "MAX_SOURCES", 1)
    with pytest.raises(ValueError, match="pool"):
        source_mix.mix_sources(frame(spark, rows))


def test_lm_base_score_and_normalisation(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    words = {r["doc_id"]: [w.decode() for w in r["text"].encode().lower().split()] + ["\n"] for r in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in words[i])
    total, types = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect()}
    for i, ws in words.items():
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(ws), sum(w in counts for w in ws), total, i not in train)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    probs = np.exp(lm_score.log_softmax(np.random.default_rng(0).normal(size=(lm_score.BUCKETS, lm_score.CLASSES)), lm_score.features(np.arange(500))))
    assert np.allclose(probs[:, : lm_score.START_CLASS].sum(1), 1)


def test_toxicity_held_out_and_misspelt(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught, wrong = [r["predicted"] for r in scored if r["toxic"] == 1], [r["predicted"] for r in scored if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.01
    rng = random.Random(2)
    clean = [" ".join(f"word{rng.randint(0, 500)}" for _ in range(40)) for _ in range(400)]
    model = toxicity.train([(t + (" horrible" if i % 4 == 0 else "")).encode() for i, t in enumerate(clean)], [int(i % 4 == 0) for i in range(400)])
    probability = lambda w: 1 / (1 + math.exp(-model.margin(*model.word(w))))
    assert probability(b"horrible") > 0.7 and probability(b"horrib1e") > 0.5 > probability(b"unseen")


def test_near_duplicates_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([8, 60, 400]))
        texts.append(base)
        for _ in range(rng.choice([0, 1, 6])):
            other = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 15])):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            texts.append(other)
    shingled = [Counter(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))) for t in texts]
    parent = list(range(len(texts)))
    links = []
    for i in range(len(texts)):
        for j in range(i):
            m = sum((shingled[i] & shingled[j]).values())
            if m / (sum(shingled[i].values()) + sum(shingled[j].values()) - m) >= 0.8:
                links.append((i, j))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(links) > 30


def test_near_duplicates_among_texts_that_share_a_passage(spark):
    """Pairs of near copies inside one large group of texts that share over half of their words."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(40)]
        changed = [*own[:-1], "changed"]
        texts += [passage + " " + " ".join(own), passage + " " + " ".join(changed if i % 3 == 0 else rng.sample(own, 40))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    ids = dict(zip(range(len(texts)), order))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, [(ids[k], t, "s") for k, t in enumerate(texts)])).collect()}
    for k in range(0, len(texts), 2):
        a, b = ids[k], ids[k + 1]
        assert (got[a], got[b]) == ((min(a, b),) * 2 if k // 2 % 3 == 0 else (a, b))


def test_near_duplicates_equal_brute_force_where_most_of_a_text_is_shared(spark):
    """A passage of 84 to 87 % of texts whose other words make few of them alike, with short texts and other passages."""
    rng = random.Random(21)
    passages = [[f"p{k}x{i}" for i in range(344)] for k in range(2)]
    passages.append(passages[0][:330] + [f"p2x{i}" for i in range(14)])
    texts = []
    for i in range(180):
        passage = passages[0 if i < 120 else 1 + i % 2]
        own = [f"o{i}x{j}" for j in range(57)]
        near = own[:20] + [f"c{i}x{j}" for j in range(rng.choice([36, 37, 38]))] if i % 2 else [f"d{i}x{j}" for j in range(56)]
        texts += [passage + own, passage + near]
    texts += [passages[1] + [f"short{j}" for j in range(20)]]
    rng.shuffle(texts)
    shingled = [near_dedup.labelled_shingles(near_dedup.word_hashes(" ".join(t).encode())) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.similarity_of(shingled[i], shingled[j], 0.8) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(label)) and 60 < len(set(label)) < len(texts) - 60


def test_alignment_follows_order():
    a = near_dedup.labelled_shingles(np.arange(100, dtype=np.uint32))
    swapped = near_dedup.labelled_shingles(np.concatenate([np.arange(50, 100), np.arange(50)]).astype(np.uint32))
    assert near_dedup.similarity_of(a, a, 0.8) == 1 and near_dedup.similarity_of(a, swapped, 0.8) < 0.8
    same = near_dedup.labelled_shingles(np.zeros(20, np.uint32))
    assert len(np.unique(same)) == len(same)


PARA = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><header>Site</header><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>{PARA}<p>Short.</article><footer>f</footer>", f"T & U {PARA.strip()} Short."),
        (f"<div class='sidebar'>{PARA}</div><div id=content><h2>A</h2><p>{PARA}</p><ul><li>one<li>two</ul><div class='ad'>buy</div></div><div id='comments'><p>{PARA}</p></div>", f"A {PARA.strip()} one two"),
        (f"<main><article><section>{PARA * 3}</section><section>b<br>c&nbsp;d</section></article><article class=comment>{PARA * 9}</article></main>", f"{(PARA * 3).strip()} b c d"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
        ("plain <b>te</b>xt", "plain text"),
        (f"<html><head><title>t</title><meta name=a><body><p>{PARA}<p>More.", f"{PARA.strip()} More."),
        (f"<head><title>t</title><p>{PARA}<p>More.", f"{PARA.strip()} More."),
    ],
)
def test_html_text(html, want):
    assert html_text.extract(html) == want


def test_html_keeps_chosen_blocks_beside_the_longest():
    lead, end = "The lead says what this page is about. " * 7 + "It is long.", "The end says where it all came from. " * 7 + "It is long."
    plain = f"<div id=content><p>{lead}</p><section>{f'<p>{PARA * 3}</p>' * 24}</section><p>{end}</p></div>"
    assert html_text.extract(plain) == " ".join([lead, *[(PARA * 3).strip()] * 24, end])
    two = f"<main><p>{lead}</p><article><p>{PARA * 5}</p></article><article><p>{PARA * 3}</p></article></main>"
    assert html_text.extract(two) == " ".join([lead, (PARA * 5).strip(), (PARA * 3).strip()])


def test_html_reads_on_after_unknown_declarations():
    assert html_text.extract("<p>a</p><![foo[x]]><p>b</p>") == "a b" and html_text.extract("<p>a<![ x>b") == "ab"


LINKS = "<div>" + "".join(f"<a href=x{i}>Page {i}</a> " for i in range(8)) + "</div>"


def test_html_regions_come_from_the_clusters(monkeypatch):
    """Pages without article or telling names: what the ratios don't choose goes, and stays if they are switched off."""
    body = "".join(f"<p>{PARA * 2}</p>" for _ in range(6))
    page = f"<body>{LINKS * 3}<div><h2>Title</h2>{body}<p>Short.</p>{body}</div>{LINKS * 2}<div>Version 3</div></body>"
    want = " ".join(["Title", *[(PARA * 2).strip()] * 6, "Short.", *[(PARA * 2).strip()] * 6])
    assert html_text.extract(page) == want
    two = f"<body>{LINKS * 3}<div>{body}</div>{LINKS * 4}<div>{body}</div>{LINKS * 3}</body>"
    assert html_text.extract(two) == " ".join([(PARA * 2).strip()] * 12)
    monkeypatch.setattr(html_text, "clusters", lambda blocks, *_: [(0, len(blocks) - 1)])
    assert "Page 7" in html_text.extract(page) and "Version 3" in html_text.extract(page) and "Page 7" in html_text.extract(two)


def test_html_time_is_linear_in_deep_pages():
    began = time.time()
    assert html_text.extract("<div>x" * 100_000).count("x") == 100_000
    assert html_text.extract("<div>" * 50_000 + "<td><li>" * 50_000 + "</section>y</b>" * 50_000).count("y") == 50_000
    assert html_text.extract("<table><tr><td><ul><li>" * 20_000 + "z").count("z") == 1
    assert time.time() - began < 12


def test_html_form_around_the_page():
    text = f"<h1>T</h1><p>{PARA * 3}</p><p>{PARA}</p>"
    want = f"T {(PARA * 3).strip()} {PARA.strip()}"
    assert html_text.extract(f"<body><form action=x><input name=s>{text}<button>Go</button></form></body>") == want
    assert html_text.extract(f"<body>{text}<form><p>{PARA}</p></form></body>") == want
    assert html_text.extract(f"<body><article>{text}</article><form><p>{PARA * 30}</p></form></body>") == want


LINKS = "<div>" + "".join(f"<a href=x{i}>Page {i}</a> " for i in range(8)) + "</div>"


def test_html_regions_come_from_the_clusters(monkeypatch):
    """Pages without article or telling names: what the ratios don't choose goes, and stays if they are switched off."""
    body = "".join(f"<p>{PARA * 2}</p>" for _ in range(6))
    page = f"<body>{LINKS * 3}<div><h2>Title</h2>{body}<p>Short.</p>{body}</div>{LINKS * 2}<div>Version 3</div></body>"
    want = " ".join(["Title", *[(PARA * 2).strip()] * 6, "Short.", *[(PARA * 2).strip()] * 6])
    assert html_text.extract(page) == want
    two = f"<body>{LINKS * 3}<div>{body}</div>{LINKS * 4}<div>{body}</div>{LINKS * 3}</body>"
    assert html_text.extract(two) == " ".join([(PARA * 2).strip()] * 12)
    monkeypatch.setattr(html_text, "clusters", lambda blocks, *_: [(0, len(blocks) - 1)])
    assert "Page 7" in html_text.extract(page) and "Version 3" in html_text.extract(page) and "Page 7" in html_text.extract(two)


def test_html_time_is_linear_in_deep_pages():
    began = time.time()
    assert html_text.extract("<div>x" * 100_000).count("x") == 100_000
    assert html_text.extract("<div>" * 50_000 + "<td><li>" * 50_000 + "</section>y</b>" * 50_000).count("y") == 50_000
    assert html_text.extract("<table><tr><td><ul><li>" * 20_000 + "z").count("z") == 1
    assert time.time() - began < 12


def test_html_form_around_the_page():
    text = f"<h1>T</h1><p>{PARA * 3}</p><p>{PARA}</p>"
    want = f"T {(PARA * 3).strip()} {PARA.strip()}"
    assert html_text.extract(f"<body><form action=x><input name=s>{text}<button>Go</button></form></body>") == want
    assert html_text.extract(f"<body>{text}<form><p>{PARA}</p></form></body>") == want
    assert html_text.extract(f"<body><article>{text}</article><form><p>{PARA * 30}</p></form></body>") == want


def test_html_pages_of_the_data(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    import html as h

    for r in html_text.extract_text(pages, keep=["page_id"]).join(pages, "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(h.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split()) and r["n_chars"] == len(r["text"])


def test_quality_verdict_rejects_depleted_documents(spark):
    shared = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, f"{shared}\n" + " ".join("own" + chr(97 + i // 26) + chr(97 + i % 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(20 if i < 30 else 200)), "h") for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.score_quality(frame(spark, rows)).collect()}
    assert all(got[i]["lost_words"] == 40 for i in got) and sorted(i for i in got if got[i]["kept"]) == list(range(30, 60))


def test_toxicity_sample_passes_over_texts_beyond_the_budget(spark, monkeypatch):
    rows = [(i, ("very long " * 60 if i % 4 < 2 else f"text {i}"), "s") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, ys: Counter(ys))
    assert toxicity.fit(frame(spark, rows), labels, max_chars=1000) == {0: 20, 1: 20}


def test_short_items_are_found_with_a_word_changed(spark):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (5, 6, 7, 8)}
    docs, truth = [], set()
    for n, item in items.items():
        for k in range(-1, n):
            truth.add((len(docs), n))
            docs.append((len(docs), " ".join(["before", "it", *("zzz" if j == k else w for j, w in enumerate(item)), "after"]), "s"))
        docs.append((len(docs), " ".join(["before", *("zzz" if j < 2 else w for j, w in enumerate(item))]), "s"))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(frame(spark, docs), bench).collect()} == truth


def test_near_duplicates_in_a_large_group_with_random_edits(spark):
    """Copies of one text that isn't there itself, so that some pairs of the group are alike and others not: every link counts."""
    rng = random.Random(33)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(260):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            text[at] = f"e{i}x{at}"
        texts.append(text)
    shingled = [near_dedup.labelled_shingles(near_dedup.word_hashes(" ".join(t).encode())) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.similarity_of(shingled[i], shingled[j], 0.8) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 200


def test_near_duplicates_of_ids_with_several_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(1, one, "s"), (1, two, "s"), (2, one + " more", "s"), (3, two + " more", "s"), (4, three, "s"), (None, three + " end", "s"), (5, three, "s"), (5, three, "s")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, None): 1, (None, None): 1, (5, None): 2})


def test_sketches_of_long_texts_come_piece_by_piece(monkeypatch):
    shingles = near_dedup.labelled_shingles(np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint32))
    whole = near_dedup.sketch(shingles)
    monkeypatch.setattr(near_dedup, "PIECE", 7)
    assert (near_dedup.sketch(shingles) == whole).all()
    assert near_dedup.sketch(near_dedup._mix(np.arange(2_000_000, dtype=np.uint64))).shape == (near_dedup.SKETCHES,)


def held_by_brute_force(docs, items, window=13, similarity=0.8):
    """(document, item) pairs with an alignment that counts, every diagonal compared."""
    out = set()
    for d, words in docs:
        for i, item in items:
            n = len(item)
            w = min(window, n)
            for diag in range(-n + 1, len(words)):
                same = [0 <= diag + j < len(words) and words[diag + j] == item[j] for j in range(n)]
                if any(10 * sum(same[k : k + w]) >= 10 * similarity * w for k in range(n - w + 1)):
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_contamination_of_all_lengths_and_all_changes(spark, monkeypatch, broadcast):
    """Items of 1 to 16 words with every pair of words changed, one word lost or inserted, and cut short, in documents of any length."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 20)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in range(1, 17)]
    docs = []
    for n, item in items:
        for a in range(n):
            for b in range(a, n):
                if a == b or n > 8 or (a + b) % 3 == 0:
                    docs.append(["zz" if k in (a, b) else w for k, w in enumerate(item)])
        docs += [["before", *item], [*item, "after"], item[: n // 2] + item[n // 2 + 1 :], [*item[: n // 2], "new", *item[n // 2 :]], item[n // 3 :], item[: n - n // 3]]
    docs = list(enumerate(docs))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items], "item_id long, text string")
    got = decontaminate.find_contamination(frame(spark, [(d, " ".join(x), "s") for d, x in docs]), bench).collect()
    want = held_by_brute_force(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and 300 < len(want) < len(docs)


def test_masks_leave_no_case_open():
    from itertools import combinations

    for similarity in (0.6, 0.8, 0.9, 1.0):
        for n in range(1, 14):
            differ = decontaminate.allowed(n, similarity)
            masks = decontaminate.masks_for(n, differ)
            for changed in combinations(range(n), differ):
                assert any(not set(changed) & {p + at for p in m} for m in masks for at in range(n - m[-1])), (n, similarity, changed)


def test_contamination_with_repeated_ids_and_hot_seeds(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (2, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, "x one two three four five six", "s"), (1, "nothing", "s"), (2, "alpha beta gamma delta epsilon zeta " * 50, "s"), (None, "seven eight nine ten eleven twelve", "s")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (None, None)}


def test_token_counts_of_endless_words(monkeypatch):
    """Words without an end: the same counts with a trie of any depth, in bounded memory."""
    pieces = token_count.load_pieces(token_count.TOKENIZER)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeéz漢", k=n)).encode() for n in (5, 255, 256, 257, 600, 3000)]
    monkeypatch.setattr(token_count, "MAX_DEPTH", 10_000)
    whole = [token_count.ForwardTrie(pieces).count(w) for w in words]
    monkeypatch.setattr(token_count, "MAX_DEPTH", 256)
    trie = token_count.ForwardTrie(pieces)
    assert [trie.count(w) for w in words] == whole
    monkeypatch.setattr(token_count, "MAX_DEPTH", 20)
    assert [token_count.ForwardTrie(pieces).count(w) for w in words] == whole
    monkeypatch.setattr(token_count, "MAX_DEPTH", 256)
    few = {p: x for p, x in pieces.items() if len(p) < 3}  # for speed; memory is the same
    trie = token_count.ForwardTrie(few)
    tracemalloc.start()
    assert trie.count(b"abcab" * 50_000) > 10**5 and len(trie.children) <= 257 and not trie.terminal
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000_000  # the text, decoded and with its mark
    assert trie.count(b"abcab" * 2_000_000) > 10**6 and len(trie.children) <= 257 and not trie.terminal


def test_lm_score_by_brute_force(spark):
    """Scores token by token from the model's tables, and the sums within classes word by word."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    _, counts, model = lm_score.fit(docs)
    count = {r["words"]: (r["c"], r["ending"]) for r in counts.collect()}
    signed = lambda keys: keys.sorted.view(np.int64).tolist()
    weights, sums = (dict(zip(signed(a), b.tolist())) for a, b in ((model.words.features, model.words.weights), (model.words.cells, model.words.log_sums)))
    kept, C = set(signed(model.words.contexts)), lm_score.CLASSES
    assert len(weights) > 500
    number = lambda *xs: int(lm_score._hash(*(np.array([x]) for x in xs))[0])

    def context_of(one, two):
        return next((c for c in (number(0, one, two), number(1, one), number(2, two)) if c in kept), None)

    def score(text):
        out, history, one, two = 0.0, [lm_score.START_CLASS] * 3, 1, 2
        for word in [*(text or "").encode().lower().split(), lm_score.END]:
            key = lm_score.word_key(word)
            c = model.top.get(key, lm_score.TOP + lm_score.ending(word))
            out += model.table[((history[0] * C + history[1]) * C + history[2]) * C + c]
            if lm_score.TOP <= c < lm_score.END_CLASS:
                out += math.log10(count.get(key, (0, 0))[0] + 0.5) - model.log_sizes[c]
                context = context_of(one, two)
                if context is not None:
                    out += (weights.get(number(context, key), 0.0) - sums.get(number(context, c), 0.0)) / math.log(10)
            history = [c, *history[:2]]
            one, two = key, one if one != 1 else 2
        return out

    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}
    texts = [r for r in docs.orderBy("doc_id").collect() if len(r["text"] or "") < 4000][:40]
    assert all(got[r["doc_id"]] == pytest.approx(score(r["text"]), rel=1e-5) for r in texts)
    words = {c: [(k, n) for k, (n, e) in count.items() if model.top.get(k, lm_score.TOP + e) == c] for c in range(lm_score.TOP, lm_score.END_CLASS)}
    for context in sorted(kept)[:30]:
        c = next(c for c in words if number(context, c) in sums) if any(number(context, c) in sums for c in words) else None
        if c is not None:
            size = 10 ** model.log_sizes[c]
            whole = sum((n + 0.5) / size * math.exp(weights.get(number(context, k), 0.0)) for k, n in words[c]) + 0.5 / size
            assert whole == pytest.approx(math.exp(sums[number(context, c)]), rel=1e-3)


def test_lm_gains_on_held_out_text(spark):
    scored = lm_score.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score") - F.sum("base_score"), F.sum("n_tokens")).first()
    assert scored[0] / scored[1] > 0.25


def test_lm_weights_meet_their_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    cell = np.repeat(np.arange(50), 6)
    p, n = rng.uniform(1e-6, 0.02, 300), rng.integers(1, 40, 300).astype(float)
    total = np.bincount(cell, n)[cell] + rng.integers(0, 9, 50)[cell]
    few, sums = lm_score.word_weights(cell, p, n, total)
    monkeypatch.setattr(lm_score, "WORD_UPDATES", 3000)
    weight, log_sum = lm_score.word_weights(cell, p, n, total)
    assert np.abs(p * np.exp(few - sums) - p * np.exp(weight - log_sum)).max() < 0.01  # the updates made by default come near
    q = p * np.exp(weight - log_sum)
    assert np.abs(n - total * q - weight / lm_score.SPREAD).max() < 1e-3
    assert np.allclose(np.exp(log_sum), (1 + np.bincount(cell, p * np.expm1(weight)))[cell])


def test_most_frequent_features_without_a_sort(spark):
    rows = spark.createDataFrame([(i, i, 1 + i % 7) for i in range(7000)], "context long, word long, n long")
    assert lm_score.most_frequent(rows, 10**6).count() == 7000 and lm_score.most_frequent(rows.limit(0), 10).count() == 0
    got = Counter(r["n"] for r in lm_score.most_frequent(rows, 2500).collect())
    assert got[7] == got[6] == 1000 and 400 < got[5] < 600 and not got[4]


def test_lm_features_have_no_limit_and_no_blocks(spark, monkeypatch):
    """A passage that two blocks hold once each is learnt; nothing hangs on blocks or numbers of features."""
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    shared = " ".join(f"rare{chr(97 + i % 26)}{i}" for i in range(60))
    rows = [(i, f"{shared if i in train[:2] else ''} " + " ".join(f"w{(i * 7 + j * j) % 300}" for j in range(120)), "s") for i in range(400)]
    rows.append((10**6, " ".join(f"lone{chr(97 + i % 26)}{i}" for i in range(60)), "s"))
    assert zlib.crc32(b"1000000") % 5 != 1
    docs = frame(spark, rows)

    def scores(docs):
        return {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}

    one = scores(docs.coalesce(1))
    assert scores(docs.repartition(5, (F.col("doc_id") == train[0]).cast("int"), F.col("doc_id") % 7)) == pytest.approx(one, rel=1e-6)
    monkeypatch.setattr(lm_score, "MAX_FEATURES", 10)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 3000)
    assert scores(docs.coalesce(1)) == pytest.approx(one, rel=1e-6)


def test_lm_features_by_brute_force(spark):
    """Features, kept contexts and their counts are those of all training tokens, kind by kind."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    _, _, model = lm_score.fit(docs.repartition(4))
    number = lambda *xs: int(lm_score._hash(*(np.array([x]) for x in xs))[0])
    left = []
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            one, two = 1, 2
            for word in [*(r["text"] or "").encode().lower().split(), lm_score.END]:
                key = lm_score.word_key(word)
                if lm_score.TOP <= model.top.get(key, lm_score.TOP + lm_score.ending(word)) < lm_score.END_CLASS:
                    left.append(((0, one, two), (1, one), (2, two), key))
                one, two = key, one if one != 1 else 2
    contexts, features = set(), set()
    for kind in range(3):
        counts = Counter((t[kind], t[3]) for t in left)
        kept = {c for (c, _), n in counts.items() if n >= 2}
        contexts |= {number(*c) for c in kept}
        features |= {number(number(*c), key) for c, key in counts if c in kept}
        left = [t for t in left if t[kind] not in kept]
    assert set(model.words.contexts.sorted.view(np.int64).tolist()) == contexts
    assert set(model.words.features.sorted.view(np.int64).tolist()) == features and len(features) > 2000


def test_lm_blocks_are_shuffled_once_a_step_and_stale_files_go(spark, monkeypatch):
    """Scores don't hang on rounds and shares; asking of the first two kinds reads stored blocks without a
    shuffle, and of what is stored on the way only the blocks and answers that scores read stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(6)
    shuffled, gone = [], []
    by_block, discard = lm_score._by_block, lm_score._discard
    monkeypatch.setattr(lm_score, "_by_block", lambda *args: shuffled.append(args[3]) or by_block(*args))
    monkeypatch.setattr(lm_score, "_discard", lambda stored: gone.extend(stored.inputFiles()) or discard(stored))
    monkeypatch.setattr(lm_score, "PART_TOKENS", 5000)

    def scores():
        shuffled.clear()
        return {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs).collect()}

    first = scores()
    assert len(shuffled) == 2 * lm_score.SHARES + 2  # stored, told the first kind; asked the last kind, scored
    assert gone and not any(os.path.exists(f.removeprefix("file:")) for f in gone)
    monkeypatch.setattr(lm_score, "ROUNDS", (1, 3, 2))
    monkeypatch.setattr(lm_score, "SHARES", 3)
    assert scores() == pytest.approx(first, rel=1e-9)


def test_lm_orders_and_planes():
    rng = np.random.default_rng(5)
    near = np.repeat(rng.integers(-(2**63), 2**63 - 1, 40), 50) ^ rng.integers(0, 4, 2000)  # the same first bits
    for x in (near, rng.integers(-(2**63), 2**63 - 1, 3000), np.repeat(rng.integers(0, 2**62, 30), 9), np.array([], np.int64), np.array([-1, 0, -1])):
        assert (lm_score.stable_order(x) == np.argsort(x.view(np.uint64), kind="stable")).all()
        first, number = lm_score.numbered(x)
        want = np.unique(x.view(np.uint64), return_index=True, return_inverse=True)[1:]
        assert (first == want[0]).all() and (number == want[1]).all()
        for y in (x, x.astype(np.uint32), x.astype(np.uint8)):
            assert (lm_score._from_planes(lm_score._planes(y), y.dtype.type) == y).all()


def test_quality_lines_are_removed(spark):
    shared, twice = "A shared line 7 of the host", "a shared line 9 OF the host"  # one line, normalised
    rows = [(i, "\n".join(["", shared if i % 2 else twice, f"own line {'x' * (i + 1)}", " "]), "h") for i in range(30)]
    rows += [(100, f"{shared}\nother host", "g"), (101, None, "h"), (102, shared, None), (None, f"{shared}\nkept", "h"), (3, f"{shared}\nagain", "h")]
    got = Counter((r["doc_id"], r["text"]) for r in quality_rules.remove_lines(frame(spark, rows)).collect())
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if s != "h" or x not in (shared, twice))) for i, t, s in rows)
    assert got == want
    # Rows of one id are one document of a line.
    few = [(i % 15, f"{shared}\nline {'y' * i}", "h") for i in range(40)]
    assert all(shared in r["text"] for r in quality_rules.remove_lines(frame(spark, few)).collect())
    assert all(r["lost_words"] == 0 for r in quality_rules.score_quality(frame(spark, few)).collect())


def test_line_dedup_merges_in_steps_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    pool = [" ".join(f"line{i}word{j}" for j in range(6)) for i in range(40)]
    docs = frame(spark, [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)) + ["short"]), "s") for i in range(120)]).repartition(13)
    shown = lambda: sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect())
    whole = shown()
    monkeypatch.setattr(line_dedup, "MERGE_BYTES", 1000)
    assert shown() == whole
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    assert shown() == whole and sum(r[3] for r in whole) > 100
    monkeypatch.setattr(line_dedup, "twice_filter", lambda lines, bits, *_: np.full((1 << bits) // 8, 255, np.uint8))  # full: every line is a suspect
    assert shown() == whole


def test_toxicity_scores_by_brute_force_and_ties(spark):
    clean = [" ".join(f"word{i * j % 97}" for j in range(30)) for i in range(60)]
    model = toxicity.train([(t + (" vile" if i % 3 == 0 else "")).encode() for i, t in enumerate(clean)], [int(i % 3 == 0) for i in range(60)], buckets=1 << 12)
    texts = [None, "", "  ", "vile", "so VILE!", "v1le vilest", clean[0], "vile " * 40, "..."]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, text in enumerate(texts):
        share = total = 0.0
        for raw in (text or "").lower().split():
            word = raw.strip(toxicity.STRIP.decode())
            if word:
                marked = f"<{word}>"
                grams = [marked[k : k + n] for n in range(3, 7) for k in range(len(marked) - n + 1)] + ([marked] if len(marked) > 6 else [])
                at = [zlib.crc32(g.encode()) % (1 << 12) for g in grams]
                share += sum(bool(model.kept[a]) for a in at) / len(at)
                total += sum(float(model.margins[a]) for a in at if model.kept[a]) / len(at)
        want = 1 / (1 + math.exp(-(model.bias + total / (share + toxicity.PRIOR))))
        assert got[i][0] == pytest.approx(want, rel=1e-5) and got[i][1] == int(got[i][0] >= 0.7)
    assert got[3][0] > 0.7 > got[6][0] and got[0] == got[1] == got[2] == got[8]
    at_threshold = toxicity.score_toxicity(frame(spark, [(3, "vile", "s")]), model, threshold=got[3][0])
    assert at_threshold.first()["predicted"] == 1


def test_lm_keys_are_found():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300, 50_000):
        held = rng.integers(-(2**63), 2**63 - 1, n)
        keys = lm_score.Keys(np.concatenate([held, held]))
        asked = np.concatenate([held, rng.integers(-(2**63), 2**63 - 1, 100), [0, -1, 2**63 - 1, -(2**63)]])
        places = dict(zip(keys.sorted.view(np.int64).tolist(), range(len(keys))))
        assert keys.find(asked).tolist() == [places.get(x, -1) for x in asked.tolist()]


def test_quality_limit_does_not_grow_with_the_host(spark):
    shared = " ".join(f"shared{chr(97 + i)}" for i in range(26))
    for size in (30, 3000):
        rows = [(i, (f"{shared}\n" if i < 21 else "") + f"own {'z' * i}", "h") for i in range(size)]
        rows += [(size + i, f"{shared}\nown {'q' * i}", "g") for i in range(20)]
        lost = {r["doc_id"]: r["lost_words"] for r in quality_rules.score_quality(frame(spark, rows)).collect()}
        assert {i for i, n in lost.items() if n} == set(range(21)) and lost[0] == 26
