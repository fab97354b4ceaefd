import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ann_forest, bpe, chat_format, decontaminate, katz_lm, quality_cnn, secret_ledger, simhash_tiles, toxicity_subword, url_rules
from sievelight.llm.queries import word_bpe_path

LOW = {i: i + 32 for i in range(65, 91)}


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names clash with those that operators add
    return df.withColumns({c: F.lit(1) for c in ("fp", "label", "term", "blob", "held", "part")}) if extra else df


EDGE = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "x y z"), (4, "word " * 40_000), (5, "a b c d e"), (6, "é😀 ß\x0b\tq")]


def test_ann_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:130] = v[7]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(600)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, []), (None, [1.0] * 16), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = ann_forest.nearest(df, lambda i: i % 50 == 0, block=256).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    found, total = 0, 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        best = sorted((-round(s[i], 12), i) for i in range(600) if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - sc) < 1e-9 for _, i, sc in mine)
        found += len({i for _, i in best} & {i for _, i, _ in mine})
        total += 5
    assert {r.query_id for r in got} == set(range(0, 600, 50)) and found / total >= 0.9
    same = [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)]
    assert same == [7, 101, 102, 103, 104]
    assert ann_forest.nearest(df.filter("vec_id < 3"), lambda i: i == 0).count() == 2
    assert ann_forest.nearest(df.filter("vec_id < 0"), lambda i: i == 0).count() == 0
    for name, value in (("BLOCK_BYTES", 1), ("QUERY_BLOCK", 3), ("QUERY_GROUP", 2)):
        monkeypatch.setattr(ann_forest, name, value)
    exact = ann_forest.nearest(df, lambda i: i % 50 == 0, block=300, share=ann_forest.TREES).collect()
    for q in range(0, 600, 50):  # every row a candidate: the exact answer
        s = unit @ unit[q]
        assert [r.vec_id for r in sorted(exact, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in sorted((-round(s[i], 12), i) for i in range(600) if i != q)[:5]]


def test_ann_repeats_and_tiny_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1.0, 1.0]), (2, [1e200, -1e200]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [-3.0, 0.0])]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i.isin(0, 4), k=10).collect()
    first = {r.vec_id: r.score for r in got if r.query_id == 0}
    half = 2**-0.5
    assert first == pytest.approx({1: 1.0, 2: 0.0, 3: half, 4: half, 5: -half}) and len(got) == 10
    # of the rows with id 4 the one with the least vector bytes counts
    assert {r.vec_id: round(r.score, 9) for r in got if r.query_id == 4} == {0: round(half, 9), 1: round(half, 9), 2: round(-half, 9), 3: 0.0, 5: 0.0}


def brute_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_ledger(spark, tmp_path):
    texts = ["password=token : abcdefgh token=\"ABCDEFGH1\"", "😀é AKIA" + "A1" * 8 + " AKIA12 " + "ab0" * 8 + " Api_Key: \"xx/yy=z\" apikey=12345", "password=\"" + "f" * 30 + "\"", "secret:secret=123456 " * 50]
    rows = [*EDGE, *[(10 + i, t) for i, t in enumerate(texts)], (11, texts[0])]
    got = Counter((r.doc_id, r.base_sha256) for r in secret_ledger.report(docs(spark, rows)).collect())
    assert got == Counter((i, hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for i, t in rows)
    ledger = f"file://{tmp_path}/ledger"
    secret_ledger.findings(docs(spark, rows[:-3]), ledger).count()
    before = spark.read.parquet(ledger).count()
    secret_ledger.findings(docs(spark, rows), ledger).count()
    after = spark.read.parquet(ledger)
    assert after.count() == after.select("blob").distinct().count() == len({t or "" for _, t in rows}) > before
    clean = {r.doc_id: r.text for r in secret_ledger.redact(docs(spark, rows)).collect()}
    assert clean[1] == "a b c d e" and clean[2] is None and "AKIAA1" not in clean[11] and all(not brute_spans(t or "") for t in clean.values())
    assert secret_ledger.report(docs(spark, rows).limit(0)).count() == 0
    clash = docs(spark, rows).withColumns({c: F.lit("mine") for c in ("hit_blob", "hit_spans", "spans")})
    again = secret_ledger.redact(clash)
    assert again.columns == clash.columns and {r.hit_spans for r in again.collect()} == {"mine"} and {r.doc_id: r.text for r in again.collect()} == clean


def test_runs_that_meet_in_a_ledger_find_things_once(spark, tmp_path, monkeypatch):
    rows, ledger = docs(spark, [(1, "token=abcdef and more"), (2, "nothing"), (3, "token=abcdef and more"), (None, None)]), f"file://{tmp_path}/ledger"
    scan = secret_ledger._scan

    def meets(versions, counted, path, rules):  # another run reads the ledger before this one has appended
        scan(versions, counted, path, rules)
        monkeypatch.setattr(secret_ledger, "open_ledger", lambda spark, path: spark.createDataFrame([], secret_ledger.LEDGER))
        scan(versions, counted, path, rules)
        monkeypatch.setattr(secret_ledger, "open_ledger", opened)

    opened = secret_ledger.open_ledger
    monkeypatch.setattr(secret_ledger, "_scan", meets)
    for limit in (secret_ledger.BROADCAST_ROWS, 0):
        monkeypatch.setattr(secret_ledger, "BROADCAST_ROWS", limit)
        found = secret_ledger.findings(rows, ledger).collect()
        assert sorted((str(r.doc_id), len(r.spans)) for r in found) == [("1", 1), ("2", 0), ("3", 1), ("None", 0)]
    assert spark.read.parquet(ledger).count() > secret_ledger.known(spark, ledger).count() == 3


@pytest.mark.parametrize("share", [1e-9, 0.5, 2.0])
def test_crowded_and_other_findings_meet_alike(spark, monkeypatch, share):
    monkeypatch.setattr(secret_ledger, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(secret_ledger, "CROWDED", share)
    rows = [(i, "copy token=abcdef " * (i % 3 > 0) + str(i // 40)) for i in range(120)]
    got = {r.doc_id: r.text for r in secret_ledger.redact(docs(spark, rows)).collect()}
    assert got == {i: t.replace("token=abcdef", "[REDACTED]") for i, t in rows}


def test_secret_ledger_scans_afresh_under_other_rules(spark, tmp_path):
    rows, ledger = docs(spark, [(1, "token=abcdef and ZZ12345"), (2, "nothing")]), f"file://{tmp_path}/ledger"
    kinds = lambda rules: {r.doc_id: [rules[s.kind].kind for s in r.spans] for r in secret_ledger.findings(rows, ledger, rules).collect()}
    own = (secret_ledger.Rule("zz", "ZZ[0-9]+", 0, 3, "ZZ"),)
    assert kinds(secret_ledger.RULES) == {1: ["assign"], 2: []} and kinds(own) == {1: ["zz"], 2: []}
    assert kinds(secret_ledger.RULES[:1] + own) == {1: ["assign", "zz"], 2: []} and kinds(own) == {1: ["zz"], 2: []}
    assert spark.read.parquet(ledger).groupBy("rule_version").count().collect().__len__() == 3


def test_many_spans_in_one_text(spark):
    text = " ".join(f"x token=abc{i:06d} é" for i in range(20_000))
    rows = docs(spark, [(1, text)])
    got = secret_ledger.report(rows).first()
    assert got.n_assign == 20_000 and got.base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()
    assert secret_ledger.redact(rows).first().text == " ".join("x [REDACTED] é" for _ in range(20_000))


def test_bpe_of_one_huge_word(monkeypatch):
    import tracemalloc

    import tokenizers

    content = open(word_bpe_path()).read()
    library, codec = tokenizers.Tokenizer.from_file(word_bpe_path()), bpe.Codec(content)
    rng = np.random.default_rng(3)
    for word in ("ab" * 900 + "tion" * 300, "".join(rng.choice(list("etaoinshrdlu"), 3000)), "x" * 777, "é" * 500 + "straße" * 50):
        want = library.encode(word, add_special_tokens=False).ids
        for window in (7, 64, 1 << 16):
            monkeypatch.setattr(bpe, "WINDOW", window)
            assert list(codec.encode_word(word)) == want
    monkeypatch.setattr(bpe, "WINDOW", 4096)
    text = "".join(rng.choice(list("etaoinshrdlu"), 1_000_000))
    tracemalloc.start()
    ids = codec.encode_word(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and codec.decode(np.array(ids)).decode().replace(" ", "").replace("</w>", "") == text


def test_url_rules(spark):
    urls = [None, "nourl", "HTTP://EXAMPLE.ORG", "http://a.b.example.org/en/1x?q#", "x://org/", "x://orgs/de", "x://com/de/", "x://xcom/de/", "x://a.com/fr/?", "://?/", "x://.com/de/1", "x://example.org/es/", "x://example.org/es"] * 3
    df = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)] + [(None, "x://org/")], "page_id long, url string").withColumn("rule", F.lit("r"))

    def expected(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fit = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    want = Counter((r.page_id, *expected(r.url)) for r in df.collect())
    assert Counter(tuple(r) for r in url_rules.judge(df).collect()) == want
    assert url_rules.judge(df, rules=[]).filter("verdict <> 'allow'").count() == 0
    assert url_rules.judge(df.limit(0)).count() == 0


def test_url_rules_keep_large_ids_and_odd_paths(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "RANGE_KEYS", 5)
    ids = [2**53 + 1, 2**62 + 25, None, -(2**63), 2**63 - 1]
    urls = ["x://com/de/" + c + "q" for c in ("\U0010ffff", "\U0010ffff\U0010ffff", "a", "", "\u00e9")]
    df = spark.createDataFrame([(i, u) for i in ids for u in urls] + [(7, "x://com/de0")] * 40, "page_id long, url string")
    got = Counter((r.page_id, r.rule) for r in url_rules.judge(df).collect())
    assert got == Counter({(i, "com/de/"): len(urls) for i in ids} | {(7, None): 40})


def test_chat_round_trip(spark):
    rows = [(1, 1, "a\nb", "<|<||\\"), (1, 1, "a\nb", "x<"), (1, 2, "assistant", "|im_end|>"), (1, None, None, None), (None, 3, "assistant", "é😀<|im_sep|>"), (None, 4, "assistant", "<|im_end|><|im_start|>assistant ok"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    formatted = chat_format.format_conversations(df)
    back = {r.conv_id: [tuple(t) for t in r.t] for r in formatted.select("conv_id", chat_format.turns_of(F.col("formatted")).alias("t")).collect()}
    for conv in (1, None, 2):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert back[conv] == [(r, x) for _, _, r, x in turns]
    digest = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    loss = "é😀<|im_sep|>" + "<|im_end|><|im_start|>assistant ok"
    assert digest[None].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[None].loss_chars == len(loss)
    assert formatted.filter("conv_id is null").first().formatted.count("<|im_start|>") == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_quality_learns_and_is_stable(spark):
    rng = np.random.default_rng(1)
    words = ["the", "and", "stone", "river", "walk", "light"]
    good = [" ".join(rng.choice(words, rng.integers(3, 300))) for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    net = quality_cnn.train([t.encode() for t in good[:100] + bad[:100]], [1] * 100 + [0] * 100, 0.5, epochs=6)
    test = [t.encode() for t in good[100:] + bad[100:]]
    scores = net.scores(test)
    assert ((scores >= 0.5) == (np.arange(100) < 50)).mean() > 0.95
    assert np.allclose(scores, [net.scores([t])[0] for t in test], atol=1e-5)
    long = b"the stone " * 200_000
    assert 0 <= net.scores([long])[0] <= 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = quality_cnn.score_documents(docs(spark, EDGE), labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert quality_cnn.score_documents(docs(spark, EDGE).limit(0), labels.limit(0)).count() == 0


def test_quality_gradients_are_the_slope():
    net = quality_cnn.Network.fresh(3)
    codes, halves = quality_cnn.laid_out([b"ab" * 400, b"xyz", b""])
    y = np.array([1, 0, 1], np.float32)

    def loss():
        r, _ = net.responses(codes, halves)
        _, _, mean, most = net.pooled(np.maximum(r.max(axis=1), 0), halves)
        z = np.hstack([mean, most]) @ net.p["out"] + net.p["bias"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(codes, halves, y)
    for name, at in (("out", 3), ("out", 20), ("bias", 0), ("taps", (0, 5, 2)), ("taps", (3, 7, 4)), ("taps", (7, 6, 9)), ("shift", 1), ("embed", (97, 3))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_quality_scores_by_hand(monkeypatch):
    """Scores against the definition, position by position, whatever the slices."""
    net, half, width = quality_cnn.Network.fresh(4), quality_cnn.HALF, quality_cnn.TAPS * quality_cnn.STRIDE
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 250, 256, 300, 1500)]

    def by_hand(t):
        halves = -(-(len(t) + width) // half)
        codes = list(t) + [quality_cnn.PAD] * (halves * half - len(t))
        filters = net.p["taps"].reshape(width * quality_cnn.DIM, -1)
        tops = []
        for h in range(halves):
            best = np.zeros(quality_cnn.FILTERS)
            for at in range(h * half, (h + 1) * half, quality_cnn.STRIDE):
                if at + width <= len(codes):
                    best = np.maximum(best, net.p["embed"][codes[at : at + width]].ravel() @ filters + net.p["shift"])
            tops.append(best)
        chunks = [np.maximum(a, b) for a, b in zip(tops, tops[1:])] or tops
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.p["out"] + net.p["bias"][0]
        return 1 / (1 + np.exp(-z))

    want = [by_hand(t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(quality_cnn, "SLICE_BYTES", 2 * half)
    assert np.allclose(net.scores(texts), want, atol=1e-5)


def toxic_corpus(n=300, seed=2):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 60)) for _ in range(n)]
    insults = ["moron", "lackwit", "dullard"]
    toxic = [f"{t} {insults[i % 3]} {t} {insults[i % 3]}" for i, t in enumerate(clean[: n // 3])]
    return clean, toxic


def test_toxicity_learns_and_training_carries_it():
    clean, toxic = toxic_corpus()
    learn = clean[100:250] + toxic[:70], [0] * 150 + [1] * 70
    model = toxicity_subword.train(*learn)
    score = lambda m, t: m.score(t, toxicity_subword.Bags(m.weights))
    caught = lambda m: sum(score(m, t) >= 0.5 for t in toxic[70:])
    assert caught(model) == 30 and all(score(model, t) < 0.5 for t in clean[250:])
    assert caught(toxicity_subword.train(*learn, steps=0)) <= 3  # what was caught comes from training
    bent = ["mooron", "lakcwit", "dullart", "morron", "lackwitt", "dulllard"]
    assert sum(score(model, f"{clean[260]} {w} {clean[261]}") >= 0.5 for w in bent) >= 4
    assert score(model, " ".join(clean[200:250] * 20) + " moron " + " ".join(clean[200:250])) >= 0.5


def test_toxicity_scores_by_hand():
    """Score against a plain reading of the definition: mean over a word's bag, softmax, highest word."""
    rng = np.random.default_rng(0)
    model = toxicity_subword.Model(rng.normal(size=toxicity_subword.BUCKETS), -0.3)
    for text in ("", "!!", "Ab", "one Two three_four \u00e9t\u00e9 one", "x" * 50):
        logits = []
        for w in re.findall(r"[^\W_]+", text.lower()):
            m = f"<{w}>"
            grams = [m] + [m[i : i + 3] for i in range(len(m) - 2) if len(m) > 3] + [m[i : i + 4] for i in range(len(m) - 3) if len(m) > 4]
            logits.append(sum(model.weights[zlib.crc32(g.encode()) % toxicity_subword.BUCKETS] for g in grams) / len(grams))
        want = 1 / (1 + np.exp(-(max(logits, default=0.0) + model.bias)))
        assert model.score(text, toxicity_subword.Bags(model.weights)) == pytest.approx(want)


def test_toxicity_bags_stay_bounded(monkeypatch):
    monkeypatch.setattr(toxicity_subword, "CACHE", 10)
    bags = toxicity_subword.Bags(np.ones(toxicity_subword.BUCKETS))
    assert [bags[f"w{i}"] for i in range(50)] == [1.0] * 50 and len(bags) <= 10


def test_sample_spreads_over_long_texts_and_ignores_held_out_labels(spark):
    long = " ".join(f"n{i}" for i in range(4000))
    rows = [(1, long), (1, "zz"), (2, "short"), (5, "held out")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (9, 1)], "doc_id long, toxic int")
    learnable = F.col("label_id") != 5
    found = {r.doc_id: r.text for r in toxicity_subword.labelled_sample(docs(spark, rows), labels, "toxic", learnable, (10, 10), 800).collect()}
    assert set(found) == {1, 2} and found[2] == "short"
    assert found[1].startswith("n0 n1 ") and found[1].endswith("n3999") and len(found[1]) == 807 and "n20" in found[1]
    clean, toxic = toxic_corpus(90)
    corpus = docs(spark, list(enumerate(clean + toxic)))
    marks = [(i, int(i >= 90)) for i in range(120)]
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in marks]
    scores = [toxicity_subword.score_documents(corpus, spark.createDataFrame(m, "doc_id long, toxic int")).collect() for m in (marks, flipped)]
    assert sorted(scores[0]) == sorted(scores[1])


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    out = toxicity_subword.score_documents(docs(spark, EDGE), labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert toxicity_subword.score_documents(docs(spark, EDGE), labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity_subword.score_documents(docs(spark, EDGE).limit(0), labels).count() == 0


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    rng = np.random.default_rng(3)
    letters = list("aaabeeé ßΣσςİıñ 's're 12½²日本語😀  \t\n.,!?'") + ["<|endoftext|>", "\x1c", "\x85"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)] + ["a" * k for k in range(60)] + ["hello <|endoftext|>x<|startoftext|>", "<|endoftext|", "\0\0", "\0\0<|ENDOFTEXT|>", "\0\0<|endoftext|>", "ab" * 100_000, "x" * 70 + " " + "x" * 70]
    rows = [*EDGE, *[(100 + i, t) for i, t in enumerate(texts)]]
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    got = bpe.encode_documents(docs(spark, rows), word_bpe_path(), with_ids=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == want and all(len(r.token_ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(docs(spark, rows).limit(0), word_bpe_path()).count() == 0


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, " !! "), (5, item), (6, "beta beta gamma"), (7, "beta beta")], "item_id long, text string")
    rows = [*EDGE, (20, "beta beta gamma beta beta gamma gamma"), (10, "x " + item.upper().replace(" ", ", ") + " y"), (11, "a short, one short one"), (12, item[:40]), (13, (item + " ") * 30), (10, "other")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in bench.collect():
        w = word.findall((r.text or "").translate(LOW))
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    want = Counter()
    for i, t in rows:
        w, hit, items = word.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    items |= windows[tuple(w[s : s + n])]
        want[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        assert Counter(tuple(r) for r in decontaminate.contamination(docs(spark, rows), bench, limit=limit).collect()) == want
    clash = docs(spark, rows).withColumns({c: F.lit("mine") for c in ("dirty_id", "dirty_hash", "text_hash", "pos", "w", "words", "n_words")})
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        kept = decontaminate.keep_clean(clash, bench, limit=limit)
        assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want.elements() if not k[5]) and kept.columns == clash.columns
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, rows).limit(0), bench).count() == 0


def test_proximity_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefgh")
    bench = spark.createDataFrame([(i, " ".join(rng.choice(letters, n))) for i, n in enumerate((1, 2, 3, 4, 4, 12))], "item_id long, text string")
    rows = [(i // 2, " ".join(rng.choice(letters, rng.integers(0, 40)))) for i in range(30)] + [(None, "a b c d e f g h"), (None, "a b c d e f g h")]
    slop = 2
    count = Counter(w for _, t in rows for w in t.split())
    want = set()
    for r in bench.collect():
        words = r.text.split()
        for at in range(max(1, len(words) - 3)):
            w = words[at : at + 4]
            rarest = min(range(len(w)), key=lambda j: (count[w[j]], w[j], j))
            for i, t in rows:
                own = t.split()
                for p in (p for p, x in enumerate(own) if x == w[rarest]):
                    low, high = max(0, p - rarest - slop), min(len(own), p - rarest + len(w) + slop)
                    if not Counter(w) - Counter(own[low:high]):
                        want.add((i, r.item_id, low, high))
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        got = decontaminate.proximity_matches(docs(spark, rows), bench, window=4, slop=slop, limit=limit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def katz_by_hand(training):
    """P(w | h) after Katz (1987), from lists of tokens: plain dictionaries, no code of the operator."""
    k = 5
    words, pairs, starts = Counter(), Counter(), Counter()
    for tokens in training:
        words.update(tokens)
        for h, w in zip(["<s>", *tokens], tokens):
            pairs[h, w] += 1
            starts[h] += 1
    total = sum(words.values())

    def discount(counts):
        n = Counter(counts.values())
        out = {}
        for r in range(1, k + 1):
            common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
            d = -1.0
            if n[r] and common < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if not 0 < d < 1:  # counts too thin for Good-Turing: absolute discounting
                d = 1 - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5) / r
            out[r] = d
        return lambda r: out[r] * r if r <= k else r

    d1, d2 = discount(words), discount(pairs)
    left = 1 - sum(d1(c) for c in words.values()) / total
    unseen = left if left > 0 else 1 / (total + 1)

    def single(w):
        return d1(words[w]) / total * (1 - unseen) / (1 - left) if words[w] else unseen

    after = {}
    for (h, w), c in pairs.items():
        after.setdefault(h, {})[w] = d2(c)

    def p(h, w):
        seen = after.get(h)
        if not seen:
            return single(w)
        given = sum(seen.values()) / starts[h]
        rest = 1 - given if given < 1 else 1 / (starts[h] + 1)
        if w in seen:
            return seen[w] / starts[h] * (1 if given < 1 else starts[h] / (starts[h] + 1))
        return rest / (1 - sum(single(x) for x in seen)) * single(w)

    return p, words, total


@pytest.mark.parametrize("spread", [60, 600])
def test_katz_matches_brute_force_and_sums_to_one(spark, spread):
    rng = np.random.default_rng(4)
    vocab = [f"W{int(i)}" for i in rng.zipf(1.5, 4000) % spread]
    rows = [*EDGE, *[(100 + i, " ".join(vocab[i * 20 : i * 20 + 20])) for i in range(200)]]
    tables = spark.catalog.listTables()
    got = katz_lm.score_documents(docs(spark, rows), block_bytes=2000).collect()
    assert spark.catalog.listTables() == tables
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\n"]) for i, t in rows]
    p, words, total = katz_by_hand([w for i, w in split if zlib.crc32(("" if i is None else str(i)).encode()) % 10])
    for h in ("<s>", "w1", "w2", "word", "nowhere"):
        assert sum(p(h, w) for w in words) + p(h, "unseen") == pytest.approx(1)
    want = Counter()
    for i, w in split:
        want[i, len(w), sum(words[x] > 0 for x in w), total, round(sum(np.log10(p(h, x)) for h, x in zip(["<s>", *w], w)), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 4)) for r in got) == want
    assert katz_lm.score_documents(docs(spark, rows).limit(0)).count() == 0


def katz_of_order(training, order):
    """P(w | h) for any order, recursively over plain dictionaries; a history is a tuple."""
    grams, after, often = [Counter() for _ in range(order + 1)], [{} for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for tokens in training:
        for i, w in enumerate(tokens):
            for m in range(1, order + 1):
                h = tuple(["<s>", *tokens][max(0, i + 2 - m) : i + 1])
                grams[m][h, w] += 1
                often[m][h] += 1
                after[m].setdefault(h, set()).add(w)
    total = sum(grams[1].values())

    def discounted(m, c):
        n = Counter(grams[m].values())
        if c > 5:
            return c
        common = 6 * n[6] / n[1] if n[1] else 1.0
        d = ((c + 1) * n[c + 1] / n[c] / c - common) / (1 - common) if n[c] and common < 1 else -1.0
        return c * (d if 0 < d < 1 else 1 - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5) / c)

    left = 1 - sum(discounted(1, c) for c in grams[1].values()) / total
    unseen = left if left > 0 else 1 / (total + 1)
    known = {}

    def p(h, w, m=order):
        if m == 1:
            c = grams[1][(), w]
            return discounted(1, c) / total * (1 - unseen) / (1 - left) if c else unseen
        h = h[-(m - 1) :]
        shorter = h[-(m - 2) :] if m > 2 else ()
        if not often[m][h]:
            return p(shorter, w, m - 1)
        if (m, h) not in known:
            given = sum(discounted(m, grams[m][h, x]) for x in after[m][h]) / often[m][h]
            lower = sum(p(shorter, x, m - 1) for x in after[m][h])
            known[m, h] = (given < 1, (1 - given if given < 1 else 1 / (often[m][h] + 1)) / (1 - lower))
        whole, alpha = known[m, h]
        if grams[m][h, w]:
            return discounted(m, grams[m][h, w]) / (often[m][h] + (not whole))
        return alpha * p(shorter, w, m - 1)

    return p, {w for _, w in grams[1]}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order(spark, order):
    rng = np.random.default_rng(9)
    vocab = [f"W{int(i)}" for i in rng.zipf(1.6, 3000) % 25]
    rows = [*EDGE[:5], *EDGE[6:], *[(100 + i, " ".join(vocab[i * 20 : i * 20 + 20])) for i in range(150)], (900, "W1 W1 W1 W2 nowhere W1 W2 W3"), (901, "W1"), (902, "")]
    got = katz_lm.score_documents(docs(spark, rows), block_bytes=1500, order=order).collect()
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\n"]) for i, t in rows]
    p, words = katz_of_order([w for i, w in split if zlib.crc32(("" if i is None else str(i)).encode()) % 10], order)
    for h in (("<s>",), ("<s>", "w1"), ("w1", "w1"), ("w1", "w2", "w1"), ("nowhere", "w1"), ("w1", "nowhere")):
        assert sum(p(h, w) for w in words) + p(h, "unseen") == pytest.approx(1)
    want = Counter((i, len(w), round(sum(np.log10(p(tuple(["<s>", *w][: k + 1]), x)) for k, x in enumerate(w)), 4)) for i, w in split)
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 4)) for r in got) == want


def test_katz_leaves_nothing_behind(spark, monkeypatch):
    import pathlib

    from sievelight.llm.common import shared_dir

    rows = docs(spark, [(i, "a b a c") for i in range(30)])
    there = lambda: {f.name for f in pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("katz*")}
    before, tables = there(), spark.catalog.listTables()
    katz_lm.score_documents(rows).count()
    assert [n.startswith("katz-scores") for n in there() - before] == [True] and spark.catalog.listTables() == tables
    before = there()
    monkeypatch.setattr(katz_lm, "_merge_histories", lambda kind: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        katz_lm.score_documents(rows)
    assert there() == before and spark.catalog.listTables() == tables


def test_good_turing_discounts():
    # n_1..n_6 = 100, 40, 25, 18, 14, 11: r* / r less the common part 66/100, over 34/100
    common = 0.66
    want = [(2 * 40 / 100 / 1 - common) / 0.34, (3 * 25 / 40 / 2 - common) / 0.34, (4 * 18 / 25 / 3 - common) / 0.34, (5 * 14 / 18 / 4 - common) / 0.34, (6 * 11 / 14 / 5 - common) / 0.34]
    assert katz_lm.discounts([100, 40, 25, 18, 14, 11])[1:] == pytest.approx(want)
    assert katz_lm.discounts([10, 5, 9, 9, 9, 9])[1:] == pytest.approx([1 - 0.5 / r for r in range(1, 6)])


def test_katz_keeps_pairs_seen_once(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10][:8]
    rows = [*zip(train, ["x y q", "z q", "x w", "x w", "y", "z", "w q", "w q"]), *zip(held, ["x y q", "x z q"])]
    scores = {r.doc_id: r.score for r in katz_lm.score_documents(docs(spark, rows)).collect()}
    assert scores[held[0]] > scores[held[1]] + 0.1  # x y was seen once, x z never; y and z are alike else


def test_simhash_matches_brute_force(spark, monkeypatch):
    xxhash = pytest.importorskip("xxhash")
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)]
    near = [base[:k] + ["zz"] + base[k + 1 :] for k in range(40)]
    rows = [*EDGE, (None, ""), *[(100 + i, " ".join(w)) for i, w in enumerate([base, *near])], *[(200 + i, " ".join(rng.choice(base, 5))) for i in range(60)], (300, "ONE two"), (7, "one TWO")]

    def fingerprint(text):
        w = (text or "").translate(LOW).encode()
        w = w.split()
        if not w:
            return 0
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == label:
            break
        label = new
    ids = {k: min((i for (i, _), x in zip(rows, label) if x == k and i is not None), default=None) for k in set(label)}
    want = Counter((i, f"{fp:016x}", ids[k]) for (i, _), fp, k in zip(rows, fps, label))
    for tile in (simhash_tiles.TILE, 3):
        assert Counter(tuple(r) for r in simhash_tiles.near_duplicates(docs(spark, rows), tile=tile).collect()) == want
    kept = simhash_tiles.keep_representatives(docs(spark, rows))
    assert kept.count() == len(set(label)) and kept.columns == docs(spark, rows).columns
    for name, value in (("CROWD", 2), ("SHINGLES", 7)):  # crowded fingerprints and long texts take other paths
        monkeypatch.setattr(simhash_tiles, name, value)
    assert Counter(tuple(r) for r in simhash_tiles.near_duplicates(docs(spark, rows)).collect()) == want
    clash = docs(spark, [(1, None), (1, ""), (2, "a b"), (2, "a b")]).withColumns({c: F.lit("mine") for c in ("kept_mark", "kept_id", "kept_hash", "KEPT_order", "first", "n")})
    found = simhash_tiles.keep_representatives(clash).collect()
    assert sorted((r.doc_id, r.text, r.kept_mark, r.KEPT_order) for r in found) == [(1, None, "mine", "mine"), (2, "a b", "mine", "mine")]
    assert simhash_tiles.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.root for r in simhash_tiles.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}
