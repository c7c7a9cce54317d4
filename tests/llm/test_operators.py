"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulewright.llm import chat_format, decontaminate, jaccard_join, language_id, line_templates, lm_score, media, mixing, suffix_dedup, url_filter

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, node string, bucket int"


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, line = prose(120), prose(14)
    texts = [None, "", "   \n ", "one", "One two three", prose(40), prose(3000)]
    texts += [base, base, base.replace(base.split()[60], "zzz", 1), base + " tail", prose(30) + "\n" + line + "\n" + prose(20)]
    texts += [prose(25) + "\n" + line + "\n" + prose(9 + i) for i in range(7)] + [f"request {i} took {i * 7} ms from host{i}" for i in range(6)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[7], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(docs):
    return docs.where("false")


def test_suffix_dedup(docs):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.suffix_dedup(docs).collect()}
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    low = {}
    for o, _, b in rows:
        for k in range(len(b) - 49):
            low[b[k : k + 50]] = min(low.get(b[k : k + 50], 1 << 63), o)
    for o, i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < o:
                gone[k : k + 50] = True
        assert got[i, len(b)].kept == bytes(np.frombuffer(b, np.uint8)[~gone])
    assert suffix_dedup.suffix_dedup(empty(docs)).count() == 0


def test_hot_hashes_are_dealt_out(docs):
    a = sorted((str(r.doc_id), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert a == sorted((str(r.doc_id), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, hot=2).collect())


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in comp[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def test_jaccard_classes(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in jaccard_join.jaccard_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(rows), key=str)
    assert jaccard_join.jaccard_classes(empty(docs)).count() == 0


def test_decontamination(spark, monkeypatch, docs):
    texts = [r.text for r in docs.where("doc_id in (5, 6)").orderBy("doc_id").collect()]
    bench = spark.createDataFrame([(10, " ".join(texts[0].split()[5:25])), (9, "one TWO three"), (2, None), (3, "..."), (None, prose(15))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[5].n_words, got[5].n_hit, got[5].contaminated) == (40, 20, True)
    assert (got[4].n_hit, got[4].items) == (3, ["9"]) and got[0].n_words == 0 and got[6].n_hit == 0
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() - 2
    cut = decontaminate.decontaminate(docs, bench, "spans").where("doc_id = 5").head()
    assert cut.text.split() == texts[0].split()[:5] + texts[0].split()[25:]
    odd = spark.createDataFrame([(1, "(Keep, this!)  One--TWO three?\n and  Ünd THAT."), (2, None)], "doc_id long, text string")
    assert [r.text for r in decontaminate.decontaminate(odd, bench, "spans").orderBy("doc_id").collect()] == ["(Keep, this!)  and  Ünd THAT.", None]
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(docs), bench).count() == 0
    for bound in ("BROADCAST_WINDOWS", "BROADCAST_KEYS"):  # the same by exchange
        monkeypatch.setattr(decontaminate, bound, -1)
    assert {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()} == got and decontaminate.decontaminate(docs, bench).count() == docs.count() - 2


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rate = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * rate > 2 * sizes[s]}
        if not new:
            break
        capped |= new
    for s in order:
        want = 2 * sizes[s] if s in capped else weight[s] * rate
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want) < 1e-6 for r in own) and abs(sum(r.taken for r in own) - want) <= 2
    assert mixing.mix_sources(empty(docs)).count() == 0
    # the mix itself: rows of copies hold the words taken
    clash = docs.withColumn("copy", F.lit("c")).withColumn("key", F.lit(1))
    mix = mixing.mixed(spark, clash, "")
    assert mix.columns == [*clash.columns, "mix_copy"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = {}
    for r in mix.collect():
        got[r.source] = got.get(r.source, 0) + words(r.text)
    want = {}
    for r in rows:
        want[r.source] = want.get(r.source, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v} and mixing.mixed(spark, empty(docs), "").count() == 0


def test_language_id(spark):
    alphabets = {"en": "the and ing tion of", "de": "der und ung sch ein", "fr": "le et eau que oi", "es": "el los cion ar ez"}
    make = lambda v: " ".join("".join(rng.choice(alphabets[v].split()) for _ in range(2)) for _ in range(30))
    df = spark.createDataFrame([(i, make(v), v) for i, v in enumerate(list(alphabets) * 40)] + [(900, None, "en"), (901, "12 !!", None), (None, "der und", None)], "doc_id long, text string, lang string")
    held = language_id.held_out(F.col("doc_id"))
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df.where(~held)), held_out=held).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und"
    own = [(got[r.doc_id].lang_pred == r.lang) for r in df.where("doc_id < 900").collect() if got[r.doc_id].held_out]
    assert len(own) > 20 and sum(own) / len(own) > 0.95
    assert language_id.identify(df, language_id.train(df.where("false"))).where("lang_pred <> 'und'").count() == 0
    # a score depends on the row's text alone
    model, twice = language_id.train(df), df.unionByName(df)
    rows = [sorted(map(str, language_id.identify(x, model).collect())) for x in (twice.coalesce(1), twice.repartition(7), twice.orderBy(F.desc("text")).coalesce(1))]
    assert rows[0] == rows[1] == rows[2] and all(a == b for a, b in zip(rows[0][::2], rows[0][1::2], strict=True))
    assert language_id.identify(empty(df), model).count() == 0
    # features by hand
    text = "Ab ab, c"
    count = {}
    padded = "ab ab  c  "
    for k in range(len(text)):
        tri = padded[k : k + 3].encode()
        if tri[:2] != b"  ":
            h = int(language_id.mix(np.array([(tri[0] << 16 | tri[1] << 8 | tri[2]) + 1], np.uint64))[0]) >> (64 - language_id.BITS)
            count[h] = count.get(h, 0) + 1
    (at, w), _ = language_id.features(np.frombuffer(text.encode() + b"next", np.uint8), np.array([0, 8, 12]))
    assert at.tolist() == sorted(count) and np.allclose(w**2, [count[k] / sum(count.values()) for k in sorted(count)])


def test_lm_score(docs):
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    assert got[0].n_tokens == 0 and got[0].mean_log_prob is None and got[6].n_tokens == 3000 and got[6].log_likelihood < 0
    w = lm_score.Weights()
    tokens = np.random.default_rng(0).integers(0, lm_score.VOCABULARY, 50)
    order, cut = lm_score.by_class(tokens)
    _, _, p_top, p_low = lm_score.forward(w, tokens[order], lm_score.contexts(tokens, np.array([0, 20, 50]))[order], cut)
    assert np.allclose(p_top.sum(1), 1, atol=1e-4) and np.allclose(p_low.sum(1), 1, atol=1e-4)
    memory, before = np.full_like(w.flat, 1e-4), lm_score.log_probs(w, tokens, np.array([0, 20, 50])).mean()
    around = lm_score.contexts(tokens, np.array([0, 20, 50]))
    for _ in range(60):
        lm_score.train_step(w, memory, tokens, around, 0.05)
    assert lm_score.log_probs(w, tokens, np.array([0, 20, 50])).mean() > before + 1
    assert lm_score.lm_score(empty(docs)).count() == 0


def test_language_id_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "Model", lambda x, lang: lang)
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(510)], "doc_id long, text string, lang string")
    assert sorted(language_id.train(docs)) == sorted(f"l{i}" for i in range(510))


def test_lm_score_counts_every_word(spark, monkeypatch):
    common = [f"w{i}" for i in range(lm_score.VOCABULARY - lm_score.HASHED)]
    by_id = {}
    for i in range(200):
        h, _ = lm_score.word_hashes(np.frombuffer(f"r{i}".encode(), np.uint8), np.array([0, len(f"r{i}")]))
        by_id.setdefault(int(lm_score.mix(h)[0] % np.uint64(lm_score.HASHED)), []).append(f"r{i}")
    often, once = next(v for v in by_id.values() if len(v) > 1)[:2]
    texts = [" ".join(common * 9), f"w1 w2 {often} w3", f"w1 w2 {once} w3", f"w7 {often} w8 w9 {often}", None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").coalesce(1)
    scores = []
    for head in (lm_score.HEAD, 0):  # counts by broadcast, and all of them by exchange
        monkeypatch.setattr(lm_score, "HEAD", head)
        got = lm_score.lm_score(docs, rounds=1).orderBy("doc_id").collect()
        scores.append([r.log_likelihood for r in got])
        assert len(got) == 6 and abs(scores[-1][1] - scores[-1][2] - np.log(5)) < 1e-3 and abs(scores[-1][3] - scores[-1][4]) < 1e-3
    assert np.allclose(*scores, atol=1e-3)


def brute_tokens(line):
    vary = r"[^A-Za-z0-9_]*(?:[A-Za-z]+://\S+|\S+@\S+\.\S+)[^A-Za-z0-9_]*"
    return ["<*>" if re.search("[0-9]", w) or re.fullmatch(vary, w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]


def brute_lines(rows, min_docs=5):
    docs = {(d if d is not None else 1 << 62, t or "") for d, t in rows}
    lines = [(d, t, no, tok) for d, t in docs for no, line in enumerate(t.split("\n")) if (tok := brute_tokens(line))]
    at, temp = {}, {}
    leaf = lambda tok: (len(tok), *tok[: line_templates.DEPTH])
    for d, t, _, tok in lines:
        for p, w in enumerate(tok):
            at.setdefault((leaf(tok), p, w), set()).add((d, t))
    for d, t, no, tok in lines:
        name = tuple(w if len(at[leaf(tok), p, w]) >= min_docs else "<*>" for p, w in enumerate(tok))
        if sum(w != "<*>" for w in name) / len(name) >= line_templates.CONSTANT:
            temp.setdefault((leaf(tok), name), []).append((d, t, no))
    gone = set()
    for v in temp.values():
        if len({x[:2] for x in v}) >= min_docs:
            gone |= set(sorted(v, key=lambda x: (x[0], x[2]))[1:])
    return {(d, t): "\n".join(x for no, x in enumerate(t.split("\n")) if (d, t, no) not in gone) for d, t in docs}


@pytest.mark.parametrize("hot", [line_templates.HOT, 0])
def test_line_dedup(spark, docs, hot):
    """Leaves in buckets, and counted by Spark as those of very many lines are."""
    more = [(500 + i, f"see http://a.b/{'x' * i} or me@x.org {WORDS[i % 3]}\nmany words stand here {WORDS[i]}\n\n" + "same line\n" * (i % 4)) for i in range(24)]
    more += [(600, "y " * 60_000), (601, "\n" * 50), (602, "z\u00a0z \u3000 z\x0bz")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows)
    got = line_templates.line_dedup(docs, hot=hot).collect()
    assert sum(r.n_dropped for r in got) > 30 and len(got) == len(rows)
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), want[d if d is not None else 1 << 62, t or ""]) for d, t in rows)
    assert line_templates.line_dedup(empty(docs)).count() == 0


def test_long_lines_in_two_documents(spark, tmp_path):
    long, short, figures = prose(51), prose(50), " ".join(str(1000 + i) for i in range(60))
    texts = ["a b\n" + long, "c d e\n" + long + "\n" + short, short, figures, "f\n" + figures, figures.replace("1059", "7"), long + " 12", long + " 345", long + " x", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, figures)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in line_templates.op10_line_dedup(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    left = {1: "c d e\n" + short, 4: "f", 7: ""}
    assert got == sorted((i, int(i in left), sha(left.get(i, t))) for i, t in rows)
    step = line_templates.drop_long_lines(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text or "") for r in step) == sorted((i, left.get(i, t) or "") for i, t in rows)


def test_url_filter(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [(1, "http://a.net/x", link("c.info")), (2, "https://B.example.NET/en/1?q", link("d.info")), (3, "http://c.info/", ""), (4, "http://d.info", None), (5, None, link("a.net")), (6, "nothing", ""), (7, "http://e.info/#z", link("a.net")), (8, "http://example.com/de/", ""), (9, "http://x.org/fr/1", "")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].rule, got[1].verdict, got[2].host, got[2].path, got[2].rule) == ("net/", "block", "b.example.net", "/en/1", "example.net/en/")
    assert (got[7].verdict, got[4].verdict, got[3].verdict, got[4].path, got[5].host) == ("block", "allow", "allow", "", "")
    assert (got[8].verdict, got[9].verdict) == ("block", "allow")
    edges, seeds = {("e.info", "a.net"), ("a.net", "c.info"), ("b.example.net", "d.info")}, {"b.example.net": 0.5, "x.org": 0.5}
    hosts = {r.host for r in got.values() if r.host}
    rank = {h: seeds.get(h, 0.0) for h in hosts}
    for _ in range(80):
        new = {h: 0.85 * sum(rank[a] for a, b in edges if b == h) for h in hosts}
        back = 1 - sum(new.values())
        rank = {h: new[h] + back * seeds.get(h, 0.0) for h in hosts}
    assert all(abs(r.trust - rank[r.host]) < 1e-4 for r in got.values() if r.host)


def test_media(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        p = media.padded(bytes(i % 256 for i in range(n)))
        assert len(p) % 64 == 0 and p and media.from_png(media.to_png(p, n)) == (p, n)
    items = media.sequence('<p>a &amp; b<img src="media:11" alt="x">c</p><figure><img src="media:22"><figcaption>cap &lt;1&gt;</figcaption></figure><script>no</script><p>d')
    assert [(i["position"], i["kind"], i["digest"] or i["text"], i["caption"]) for i in items] == [(0, "text", "a & b", None), (1, "media", "11", "x"), (2, "text", "c", None), (3, "media", "22", "cap <1>"), (4, "text", "d", None)]
    data = {hashlib.sha256(x).hexdigest(): x for x in (b"abc", b"")}
    store = media.media_store(spark.createDataFrame([(k, bytearray(v)) for k, v in [*data.items(), *data.items()]], "digest string, payload binary"))
    pages = spark.createDataFrame([(i, f'<img src="media:{k}" alt="{i}">') for i, k in enumerate([*data, *data, "ff"])] + [(9, None)], "id long, html string")
    got = {r.id: r for r in media.resolve(media.parse_sequences(pages, "id", "html"), store, media.describe, media.DESCRIBED).collect()}
    assert len(got) == 5 and got[0].n_bytes == 3 and got[1].payload_bytes == 64 and got[4].n_bytes is None and got[3].caption == "3"


def png_samples(raw):
    """The samples of a grey PNG without filters, by its own reading of the format."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR"
    width, height, depth, colour = struct.unpack(">IIBB", raw[16:26])
    assert (depth, colour) == (8, 0)
    data, at = b"", 8
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = zlib.decompress(data)
    return b"".join(rows[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_media_query(spark, tmp_path, docs):
    own = docs.select("doc_id", "text", F.lit("x").alias("digest"), F.lit(1).alias("id"))
    own.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.op7_media_columns(spark, str(tmp_path)).collect())
    want = []
    for r in own.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_png(payload, len(raw))
        assert png_samples(stored) == payload
        want.append((str(r.doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert got == sorted(want)
    empty(own).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op7_media_columns(spark, f"{tmp_path}/none").count() == 0


def test_distrust(spark):
    """A host that links to blocked ones is blocked, one that trusted hosts link to is not; a link inside a query string is none."""
    link = lambda *hosts: "".join(f'<a href="//{h}/x">y</a>' for h in hosts) + '<a href="/go?u=http://b.net/">z</a>'
    rows = [(1, "http://bad.info/", link("a.net", "b.net")), (2, "http://good.info/", link("x.org")), (3, "http://x.org/fr/1", link("good.info")), (4, "http://a.net/", link("b.net")), (5, "http://b.net/", ""), (6, None, None), (6, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (got[1].verdict, got[2].verdict, got[3].verdict, got[6].verdict) == ("block", "allow", "allow", "allow")
    assert got[1].distrust > 0 and got[1].trust == 0 and got[2].trust > 0 and got[2].distrust == 0
    assert url_filter.filter_urls(pages.where("false")).count() == 0 and len(url_filter.filter_urls(pages).collect()) == 7
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, rounds=2)


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b ### c </turn> : "), (1, 1, "assistant", "\\### x"), (1, 1, "assistant", ""), (2, None, None, None), (None, 3, "assistant", "é" * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    turns = "user\na\\b ### c </turn> : \nassistant\n\nassistant\n\\### x\n"
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].loss_chars == 6
    assert got[1].loss_sha256 == hashlib.sha256(b"\\### x").hexdigest() and got[2].n_turns == 1 and got[None].loss_chars == 30000
    long = " ".join(["it's", "x" * 50, "12 34", "  ", "\u00e9t\u00e9!"] * 2000)
    tokens = chat_format.Tokens.of(chat_format.vocabulary(spark, chat_format.TOKENIZER))
    assert tokens.encode(long) == tokens.encoder.encode_ordinary(long) and len(long) > 5 * chat_format.PART
    for t in ("", "\\", "\\\\###</turn>", "###\\", "\\n :"):
        assert chat_format.unescape(chat_format.escape(t)) == t
    assert chat_format.digests(chat_format.format_turns(df.where("false"))).count() == 0


def test_pipeline(spark, tmp_path, docs):
    """Every stage on nulls, repeated rows, empty and long texts and columns of clashing names, and on an empty table."""
    import corpus_pipeline as p

    bench = spark.createDataFrame([(1, prose(20)), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = docs.withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("lines", F.lit(3)).withColumn("letter", F.lit(4))
    now, kept = odd, {}
    for name, stage in p.STAGES:
        none = stage(spark, empty(now), str(tmp_path))
        now = stage(spark, now, str(tmp_path))
        assert none.count() == 0 and none.columns == now.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
        assert now.columns == odd.columns + (["copy"] if name == "mix_sources" else [])
    start = [(r.doc_id, r.text) for r in odd.collect()]
    # stages by brute force, each on what the one before kept
    assert sorted(kept["language_id"], key=str) == sorted([x for x in start if re.search(r"[^\W\d_]", x[1] or "")], key=str)
    lines = brute_lines(kept["language_id"])
    assert sorted(kept["line_dedup"], key=str) == sorted([(d, lines[d if d is not None else 1 << 62, t]) for d, t in kept["language_id"]], key=str)
    classes = brute_classes(kept["line_dedup"])
    shingled = {(c if c is not None else "none") for _, n, c in classes if n}
    assert len(kept["near_duplicates"]) == len(shingled) + len({(d, t) for (d, t), (_, n, _) in zip(kept["line_dedup"], classes, strict=True) if not n})
    assert kept["decontaminate"] and sorted(kept["decontaminate"], key=str) == sorted(kept["near_duplicates"], key=str)
    odd.drop("copy").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == now.count()


def test_jaccard_classes_in_large_groups(spark, monkeypatch):
    """Families of near copies, cut ones among them, and unrelated texts with a common head, in groups that get pivots."""
    own = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(2):
        base = own.choices(words, k=90)
        for _ in range(45):
            t = list(base)
            for _ in range(own.randint(0, 12)):
                t[own.randrange(90)] = own.choice(words)
            rows.append((len(rows), " ".join(t[: own.randint(55, 90)] if own.random() < 0.3 else t)))
    head = own.choices(words, k=12)
    rows += [(len(rows) + k, " ".join(head + own.choices(words, k=own.randint(0, 30)))) for k in range(50)]
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "COMMON", 4)
    got = [tuple(r) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_a_small_set_in_a_group_leaves_first_tokens_of_large_ones_few(monkeypatch):
    """What links with a set has three quarters of its tokens at least, however small the smallest of the group is."""
    words = " ".join(f"w{i}" for i in range(104))  # 100 shingles
    cells = [pa.array([1]), pa.array([2]), pa.array([100]), pa.array([3]), pa.array([words]), pa.array([[]], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(cells, names=["g", "node", "n", "least", "text", "pivot"])
    order = type("Sent", (), {"value": jaccard_join.Common(np.zeros(0, np.uint64), np.zeros(0, np.int64))})
    (got,) = jaccard_join._measured(iter([batch]), 5, 1, 75, order)
    assert len(got.column("outside")[0]) == 100 - 75 + 1


def test_a_family_leads_to_few_new_groups(spark, monkeypatch):
    """Near copies that share their changes by parts of the family: next rounds' groups do not multiply with the parts."""
    own = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        t = list(base)
        for at in own.sample(range(4, 120, 7), 3):
            t[at] = f"v{at}"  # some sixth of the family has each change
        rows.append((k, " ".join(t)))
    met, opened = [], jaccard_join._open

    def counted(groups, label, first):
        if not first:
            met.append(groups.count())
        return opened(groups, label, first)

    monkeypatch.setattr(jaccard_join, "_open", counted)
    got = [tuple(r) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_classes(rows))
    assert met and sum(met) <= 10 * len(rows), met


def test_tokens_outside_pivots_become_rows_only_where_nodes_share_them():
    """Of the first tokens outside, those that one node of the group has alone lead to no group."""
    cells = [pa.array([7, 7, 8]), pa.array([1, 2, 3]), pa.array([20, 20, 20]), pa.array([[11, 12], [12, 13], [11, 12]], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(cells, names=["g", "node", "n", "outside"])
    sent = pa.Table.from_batches(list(jaccard_join._outside(iter([batch]), 1)))
    found = pa.Table.from_batches(list(jaccard_join._groups(iter(sent.to_batches()))))
    assert sorted(found.column("node").to_pylist()) == [1, 2] and len(set(found.column("g").to_pylist())) == 1


def test_lm_score_maps_embeddings_before_tokens_take_them():
    """The hidden layer is that of embeddings side by side, and gradients are those of differences."""
    w, rng = lm_score.Weights(), np.random.default_rng(3)
    w.bias[:] = rng.standard_normal(lm_score.DIM)
    tokens = rng.integers(0, lm_score.VOCABULARY, 300)
    tokens[:60] = 70
    starts = np.array([0, 200, 200, 300])
    order, cut = lm_score.by_class(tokens)
    around = lm_score.contexts(tokens, starts)[order]
    table = lm_score.mapped(w)
    hidden, top, low = lm_score.logits(w, table, tokens[order], around, cut)
    side = w.embed[around].reshape(300, -1) @ w.mix.reshape(-1, lm_score.DIM) + w.bias
    assert np.allclose(hidden, np.tanh(side), atol=1e-5)
    _, _, p_top, p_low = lm_score.forward(w, tokens[order], around, cut)
    t, i = tokens[order], np.arange(300)
    wanted = np.log(p_top[i, t // lm_score.WITHIN] * p_low[i, t % lm_score.WITHIN])
    assert np.allclose(lm_score.log_probs(w, tokens, starts)[order], wanted, atol=1e-4)
    moved, memory = lm_score.Weights(w.flat.copy()), np.zeros_like(w.flat)
    lm_score.train_step(moved, memory, tokens, lm_score.contexts(tokens, starts), 0.0)
    slope = lm_score.Weights(np.sqrt(memory))  # squared gradients of one step
    for name, at in (("mix", (1, 3, 5)), ("embed", (70, 4))):
        near = []
        for step in (1e-2, -1e-2):
            other = lm_score.Weights(w.flat.copy())
            getattr(other, name)[at] += step
            near.append(lm_score.log_probs(other, tokens, starts).mean())
        assert abs(abs(near[0] - near[1]) / 2e-2 - getattr(slope, name)[at]) < 1e-3
