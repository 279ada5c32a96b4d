"""Operators against brute force, the libraries, round trips and held-out labels."""

import base64
import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from herbarius.llm import decontaminate, hamming_topk, ngram_jaccard, pii, quality, secret_scan, sentencepiece_dropout, token_counts, toxicity, warc

DATA = "/root/testdata/sf0.01"
LETTERS = "aàéΣσſKİiß'’` \t\n<|>.,!09½一한\U0001F600‍strelvm#@$_-\x1c\x85　▁\0"


def texts(n, seed=1, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").cache()


def test_token_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    for x in [*texts(400), "<|endoftext|>a<|STARTOFTEXT|> I'll they're 'tis", "straightforwardly " * 3]:
        counts = own.at_every_prefix(x)
        assert counts[-1] == len(library.encode(x, add_special_tokens=False).ids)
    x = "Don't  stop, they'll running straightforwardly — l'été 2.0's"
    normal = own.normal(x)
    assert own.at_every_prefix(x) == [len(library.encode(normal[:i], add_special_tokens=False).ids) for i in range(len(normal) + 1)]


def test_truncation_answers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    text = "straightforwardly running they'll l'été " * 30
    r = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, limit=50).first()
    n = lambda i: len(library.encode(text.lower()[:i], add_special_tokens=False).ids)
    assert r.over_limit and n(r.fit_chars) <= 50 and n(r.fit_chars + 12) > 50


def test_merge_dropout():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p, library = sentencepiece_dropout.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    xs = [*texts(300), "x" * 200 + " the" * 30, ""]
    run = lambda dropout, seed: (lambda got: [got[0][a:b].tolist() for a, b in zip(got[1], got[1][1:], strict=False)])(sentencepiece_dropout.encode_all(p, xs, sentencepiece_dropout.document_keys(list(range(len(xs))), seed), dropout))
    assert all(ids == library.encode(x) for x, ids in zip(xs, run(0.0, 1), strict=True) if "▁" not in x)
    for dropout in (0.1, 0.5, 1.0):
        assert [sentencepiece_dropout.decode(p, ids) for ids in run(dropout, 1)] == xs
    assert run(0.5, 1) == run(0.5, 1) != run(0.5, 2)


def agenda_by_hand(sp, text, key, limit):
    """Ids by the plainest agenda: whole text, all neighbours looked at for every merge."""
    m64 = 2**64 - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & m64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    symbols = [(i, c if c == " " or c != "▁" else None, c) for i, c in enumerate(" " + text)]
    symbols = [(i, "▁" if c == " " else c if c in plain else None, own) for i, c, own in symbols]
    skipped = set()
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (i, a, _), (j, b, _) = symbols[k], symbols[k + 1]
            if a and b and a + b in plain and (i, a, j, b) not in skipped:
                at = (-sp.get_score(plain[a + b]), plain[a + b], k)
                best = min(best or at, at)
        if best is None:
            break
        k = best[2]
        (i, a, own), (j, b, _) = symbols[k], symbols[k + 1]
        if mix(mix(key + i * 0xD6E8FEB86659FD93 & m64) ^ (plain[a] << 32 | plain[b])) < limit:
            skipped.add((i, a, j, b))
        else:
            symbols[k : k + 2] = [(i, a + b, own)]
    return [x for _, piece, own in symbols for x in ([plain[piece]] if piece else [sp.piece_to_id(f"<0x{y:02X}>") for y in own.encode("utf-8", "surrogatepass")])]


def test_merge_dropout_by_a_plain_agenda():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p, sp = sentencepiece_dropout.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    xs = [*texts(60, seed=4), "the quick brown foxes jumped straightforwardly over lazy dogs", "  two  spaces and ▁ a mark", "counterrevolutionaries" * 4]
    for dropout in (0.1, 0.5):
        keys = sentencepiece_dropout.document_keys(list(range(len(xs))), 7)
        ids, cuts = sentencepiece_dropout.encode_all(p, xs, keys, dropout)
        for k, x in enumerate(xs):
            want = agenda_by_hand(sp, x, int(keys[k]), int(dropout * 2**64)) if x else []
            assert ids[cuts[k] : cuts[k + 1]].tolist() == want, (k, x)


def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = token_counts.token_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), path).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in got} == {i: (len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in rows.items()}
    text = ("straightforwardly they'll run — l'été; " * 4000)[:100_000]
    long = token_counts.prefix_token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first().prefix_tokens
    assert len(long) == len(text) + 1 and all(long[i] == len(library.encode(text[:i], add_special_tokens=False).ids) for i in (0, 1, 17, 999, 50_003, 99_999, 100_000))


def test_matrix_and_heap_agree(monkeypatch):
    p = sentencepiece_dropout.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    xs = ["the quick brown foxes jumped straightforwardly over lazy dogs"] * 5
    keys = sentencepiece_dropout.document_keys(list(range(5)), 3)
    a = sentencepiece_dropout.encode_all(p, xs, keys, 0.4)[0]
    monkeypatch.setattr(sentencepiece_dropout, "WIDE", 3)
    assert a.tolist() == sentencepiece_dropout.encode_all(p, xs, keys, 0.4)[0].tolist()


def components_by_brute_force(rows, words, num, den):
    sets = {d: set(ngram_jaccard.shingle_set(t, words).tolist()) for d, t in rows}
    held = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in collections.Counter(e for x in s for e in held[x] if e < d).items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_jaccard_components(spark, docs, words, num, den):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    r = random.Random(words)
    base = " ".join(f"w{r.randint(0, 999)}" for _ in range(120)).split()
    for i in range(150):  # a group of near copies
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = f"v{r.randint(0, 99)}"
        rows.append((10_000 + i, " ".join(copy)))
    for i in range(60):  # short texts around the edges of the bands
        rows.append((20_000 + i, " ".join(f"s{(j * (1 + i % 2)) % 40}" for j in range(5 + i % 30))))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, num, den).collect()}
    assert got == components_by_brute_force(rows, words, num, den)


def test_jaccard_ids_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (5, "else")]
    for some in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(some, "doc_id long, text string")).collect())
        assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (5, 1, 5)]


@pytest.mark.parametrize("leaf", [8, 128])
def test_jaccard_of_a_shared_passage(spark, monkeypatch, leaf):
    """Many documents of one template, linked in chains, pairs or not at all: full nodes of many components."""
    monkeypatch.setattr(ngram_jaccard, "LEAF", leaf)
    r = random.Random(leaf)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(300):
        own = base[:75] + [f"{i // 3 if i % 3 else i}x{j}" for j in range(25 + i % 9)]
        rows.append((i, " ".join(own)))
    chain = list(base)
    for i in range(60):
        chain[r.randrange(100)] = f"c{i}"
        rows.append((1000 - i, " ".join(chain)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 4, 5).collect()}
    assert got == components_by_brute_force(rows, 1, 4, 5)


def test_slabs_hold_every_link():
    """Linked sets share one of their first slabs in any common order that puts empty blocks last."""
    r, bands = random.Random(9), ngram_jaccard.Bands(4, 5)
    for _ in range(3000):
        n = r.randint(5, 300)
        a = {r.getrandbits(63) for _ in range(n)}
        b = set(list(a)[r.randint(0, n // 10) :]) | {r.getrandbits(63) for _ in range(r.randint(0, n // 10))}
        if a == b or 5 * len(a & b) < 4 * len(a | b):
            continue
        firsts = []
        for x in (a, b):
            keys, held = ngram_jaccard.slabs(np.array(sorted(x), dtype=np.uint64), bands)
            own = [sorted((int(k) & ngram_jaccard.EMPTY, int(k)) for k in keys.tolist() if int(k) & ngram_jaccard.BAND == h["band"])[: h["take"]] for h in held]
            firsts.append({k for some in own for k in some})
        assert firsts[0] & firsts[1]


def base_secrets(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    kinds = [
        ("assign", re.compile("(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    out = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(out))


def der(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)) + content


def test_secrets(spark, docs):
    r = random.Random(3)
    parts = ["token", "= ", "PassWord", ":", "'", "abcdef0123456789", "AKIA", "IOSFODNN7EXAMPLE", " ", "é", "api_key", "apikey=", "deadbeef" * 4, "-", "s", "secret"]
    fuzz = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(1500)]
    rows = fuzz + [(x.doc_id + 10_000, x.text) for x in docs.collect()]
    got = secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: base_secrets(t) for i, t in rows}
    assert all(x.base_sha256 == hashlib.sha256(want[x.doc_id].encode()).hexdigest() for x in got)
    assert sum(bool(x) for x in want.values()) > 100


def test_secret_structures():
    enc = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = ".".join([enc(json.dumps({"alg": "HS256"}).encode()), enc(b'{"sub":"a"}'), enc(b"s" * 32)])
    key = der(0x30, der(0x02, b"\0") + b"".join(der(0x02, bytes([1 + i] * 20)) for i in range(8)))
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(len(x).to_bytes(4) + x for x in (b"k" * 30, b"p" * 30))
    kinds = lambda t: [k for _, _, k in secret_scan.scan(t)]
    assert kinds(f"auth {jwt} end") == ["jwt"]
    assert kinds("x " + base64.b64encode(key).decode()) == ["der"] and "der" in kinds("x " + key.hex())
    assert kinds("x " + base64.b64encode(ssh).decode()) == ["openssh"]
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(key).decode() + "\n-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds("x " + base64.b64encode(key[:-3] + b"zz").decode()) == [] == kinds("a" * 15 + "." + "b" * 10 + "." + "c" * 10)
    assert secret_scan.redacted("a token=abcdefgh1 b") == "a <SECRET> b"


def test_wrapped_and_escaped_secrets():
    key = der(0x30, der(0x02, b"\0") + b"".join(der(0x02, bytes([1 + i] * 20)) for i in range(8)))
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(len(x).to_bytes(4) + x for x in (b"k" * 60, b"p" * 90))
    locked = lambda oid: der(0x30, der(0x30, der(0x06, bytes.fromhex(oid)) + der(0x05, b"")) + der(0x04, b"e" * 70))
    wrap = lambda x, n, end: end.join(x[i : i + n] for i in range(0, len(x), n))
    enc = lambda x: base64.b64encode(x).decode()
    kinds = lambda t: [k for _, _, k in secret_scan.scan(t)]
    for end in ("\\n", "\\r\\n", "\n"):
        assert kinds(json.dumps("x")[:1] + f"-----BEGIN PRIVATE KEY-----{end}" + wrap(enc(key), 64, end) + f'{end}-----END PRIVATE KEY-----{end}"') == ["pem"]
        for n in (64, 76):
            text = "key:\n" + wrap(enc(key), n, end)
            assert secret_scan.scan(text + "\nplain words") == [(5, len(text), "der")] and secret_scan.redacted(text) == "key:\n<SECRET>"
            assert kinds(wrap(enc(ssh), n, end) + "\nend of it") == ["openssh"]
            assert "der" in kinds(wrap(key.hex(), n, end) + "\nplain")
    assert kinds("-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + wrap(enc(locked("2a864886f70d01050d")), 64, "\n") + "\n-----END ENCRYPTED PRIVATE KEY-----") == ["pem"]
    assert kinds("x " + enc(locked("608648016503040201"))) == []
    for header in ('{\r\n"alg":"HS256"}', '{\t"alg":"HS256"}'):
        token = ".".join(base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (header.encode(), b'{"sub":"a"}', b"s" * 32))
        assert kinds(f"auth {token} end") == ["jwt"]


def test_encrypted_pem_and_secrets_in_long_texts(docs):
    wrap = lambda x: "\n".join(x[i : i + 64] for i in range(0, len(x), 64))
    body = base64.b64encode(bytes(range(7, 247))).decode()
    pem = lambda head, b: f"-----BEGIN RSA PRIVATE KEY-----\n{head}\n{b}\n-----END RSA PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n"
    good = pem(headers.format("0F" * 16), wrap(body))
    kinds = lambda t: [k for _, _, k in secret_scan.scan(t)]
    assert kinds(good) == ["pem"] and kinds(pem(headers.format("0F" * 8), wrap(body))) == [] == kinds(pem("", wrap(body))) == kinds(pem(headers.format("0F" * 16), wrap(body[:-4])))
    key = der(0x30, der(0x02, b"\0") + b"".join(der(0x02, bytes([1 + i] * 20)) for i in range(8)))
    enc = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = ".".join([enc(json.dumps({"alg": "RS256"}).encode()), enc(b'{"sub":"a"}'), enc(b"s" * 64)])
    prose = " ".join(r.text for r in docs.filter("length(text) > 2000 and doc_id < 600").orderBy("doc_id").collect())
    prose = re.sub(r"[0-9=:]", "", (prose * (1 + 600_000 // len(prose)))[:600_000])
    text, want, at = "", [], 0
    for kind, secret in (("pem", good), ("jwt", jwt), ("der", base64.b64encode(key).decode()), ("der", key.hex().upper())):
        text += prose[at : at + 150_000] + "\n"
        want.append((len(text), len(text) + len(secret), kind))
        text, at = text + secret + "\n", at + 150_000
    assert [x for x in secret_scan.scan(text) if x[2] not in secret_scan.BASE_KINDS] == want


def test_leaks(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    spaced = {i: b" ".join(decontaminate.words_of(t)) for i, t in items}
    rows = [(r.doc_id, b" ".join(decontaminate.words_of(r.text))) for r in docs.collect()]
    exact = {(d, i) for d, t in rows for i, x in spaced.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert exact <= got and len(got - exact) <= 0.01 * len(got)


def test_paraphrase(spark, docs):
    item = "the keeper of Xanthia lighthouse measured seventeen copper barometers before winter storms arrived along northern cliffs"
    close = "some say an old keeper of Xanthia lighthouse once checked seventeen copper barometers shortly ahead of storms along these cliffs and then left"
    rows = spark.createDataFrame([(1, close), (2, "storms came along the cliffs before winter")], "doc_id long, text string")
    both = docs.select("doc_id", "text").limit(200).unionAll(rows.selectExpr("doc_id + 100000", "text"))
    bench = spark.createDataFrame([(9, item, "copper barometers")], "item_id long, text string, answer string")
    got = [(r.doc_id, r.kind) for r in decontaminate.leaks(both, bench, answer_col="answer").collect()]
    assert got == [(100001, "paraphrase")]


def test_paraphrases_without_answers(spark, docs):
    """A third of a passage's words replaced, its rarest among them, partly by words of no other text."""
    r = random.Random(12)
    texts_ = [x.text for x in docs.filter("length(text) between 400 and 4000").orderBy("doc_id").limit(120).collect()]
    items, rows = [], []
    for i, text in enumerate(texts_[:20]):
        words = [w.decode() for w in decontaminate.words_of(text)][:30]
        items.append((i, " ".join(words) + f" uniquely{i}"))
        changed = [f"swap{i}x{j}" if j % 3 == 1 else w for j, w in enumerate(words)]
        rows.append((i, " ".join(texts_[60 + i].split()[:40] + changed + texts_[90 + i].split()[:40])))
    rows += [(100 + i, x) for i, x in enumerate(texts_[40:])]
    r.shuffle(rows)
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    held = dict(rows)
    assert len(got & {(i, i) for i in range(20)}) >= 16
    assert all(brute_confirmed(held[d], items[i][1], 0.5, 2) for d, i in got)  # the tables have near copies


@pytest.mark.parametrize("kind", ["fixed", "random", "swapped"])
def test_recall_of_paraphrases(spark, docs, kind):
    """Nine in ten at least: a third of the words replaced at fixed or random places, a quarter with two clauses swapped."""
    r = random.Random(5)
    texts_ = [x.text for x in docs.filter("length(text) between 400 and 4000").orderBy("doc_id").limit(500).collect()]
    others, items, rows = [w for t in texts_[400:450] for w in t.split()], [], []
    for i in range(100):
        words = [w.decode() for w in decontaminate.words_of(texts_[i])][:30]
        items.append((i, " ".join(words) + f" uniquely{i}"))
        out = {j for j in range(30) if j % 3 == 1} if kind == "fixed" else set(r.sample(range(30), 10 if kind == "random" else 7))
        changed = [r.choice(others) if j in out else w for j, w in enumerate(words)]
        if kind == "swapped":
            k = r.randint(4, 8)
            changed = changed[:10] + changed[10 + k : 10 + 2 * k] + changed[10 : 10 + k] + changed[10 + 2 * k :]
        rows.append((i, " ".join(texts_[150 + i].split()[:40] + changed + texts_[270 + i].split()[:40])))
    rows += [(1000 + i, x) for i, x in enumerate(texts_[300:])]
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    held = dict(rows)
    assert len(got & {(i, i) for i in range(100)}) >= 90
    assert all(brute_confirmed(held[d], items[i][1], 0.5, 2) for d, i in got if d != i)  # the tables have near copies


def brute_confirmed(doc, item, copy=0.8, room=1):
    """Whether some window of a text holds most of an item in order, by dynamic programming over all windows."""
    a, b = decontaminate.words_of(item), decontaminate.words_of(doc)
    for at in range(0, max(1, len(b) - len(a) + 1)):
        row = [0] * (len(a) + 1)
        for y in b[at : at + room * len(a)]:
            last = 0
            for i, x in enumerate(a):
                last, row[i + 1] = row[i + 1], last + 1 if x == y else max(row[i + 1], row[i])
        if row[-1] >= copy * len(a):
            return True
    return False


def test_copies_with_edits_by_brute_force(spark, docs):
    """Every text that holds 90 % of an item in order within the item's length is found."""
    r = random.Random(13)
    texts_ = [x.text for x in docs.filter("length(text) between 300 and 1200").orderBy("doc_id").limit(60).collect()]
    items = [(i, " ".join(texts_[i].split()[:24])) for i in range(12)]
    rows = []
    for i in range(12):
        words = items[i][1].split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(texts_[50].split())
        rows.append((i, " ".join(texts_[20 + i].split()[: r.randint(0, 60)] + words + texts_[35 + i].split()[:30])))
    want = {(d, i) for d, t in rows for i, x in items if brute_confirmed(t, x, 0.9)}
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 5 and want <= got and all(d == i for d, i in got)


def test_singular_vectors():
    r = np.random.default_rng(0)
    x = r.standard_normal((500, 8)) @ np.diag([20, 10, 5, 1, 0.1, 0.1, 0.1, 0.1]) @ np.linalg.qr(r.standard_normal((8, 8)))[0]
    d = r.standard_normal((8, 7))
    v = decontaminate.singular_vectors(d, x.T @ (x @ d), 3)
    true = np.linalg.svd(x)[2][:3].T
    assert np.allclose(np.abs(np.linalg.svd(true.T @ v)[1]), 1, atol=1e-3)


def test_warc_splits(spark):
    pages = spark.createDataFrame([(i, f"http://e/{i}", ("é\x1f\x8b\x08" * (i % 7) + str(i % 5)) * (1 + 200 * (i % 3))) for i in range(200)], "page_id long, url string, html string")
    from herbarius.llm.common import fresh_path

    path = fresh_path(spark, "w")
    warc.write_warc(pages.coalesce(2), path)
    want = {r.page_id: r.html.encode() for r in pages.collect()}
    first = {}
    for i in sorted(want):
        first.setdefault(want[i], i)
    for size in (97, 1000, 1 << 20):
        got = warc.read_warc(spark, path, size).collect()
        assert sorted(r.page_id for r in got) == sorted(want)
        for r in got:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(want[r.page_id]).digest()).decode() and r.payload_bytes == len(want[r.page_id])
            assert r.refers_to == (None if first[want[r.page_id]] == r.page_id else first[want[r.page_id]])


def test_warc_large_record_and_false_magic():
    member = warc.record("1", "u", b"\x1f\x8b\x08WARC" * 10, None, "d")
    assert warc.parse(zlib.decompress(member, 31))["payload"] == b"\x1f\x8b\x08WARC" * 10
    assert warc.EMPTY_MEMBER[-1] == 0


def test_foreign_warc(spark, tmp_path):
    import gzip

    def rec(lines, block, length=True):
        return "\r\n".join(["WARC/1.0", *lines, *([f"Content-Length: {len(block)}"] if length else [])]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    parts = [
        rec(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:a>", "Content-Type: application/warc-fields"], b"software: other\r\n"),
        rec(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:b>", "WARC-Target-URI: http://e/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: e\r\n\r\n"),
        rec(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:c>", "WARC-Target-URI: <http://e/>", "Content-Type: application/http; msgtype=response"], http),
        rec(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:d>", "WARC-Refers-To: <urn:uuid:c>", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\n\r\n"),
        rec(["WARC-Type: metadata", "Content-Type: text/plain"], b"no id\r\n", length=False),
        rec(["WARC-Record-ID: <urn:x-page:nine>", "Content-Length: many"], b"no type", length=False),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[:4]) + gzip.compress(b"not a record") + gzip.compress(parts[4]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[0] + parts[2]) + gzip.compress(parts[5]))
    for size in (40, 1 << 20):
        got = [(str(r.record_id), str(r.record_type), None if r.payload is None else bytes(r.payload), r.payload_bytes, r.page_id, r.refers_to_record) for r in warc.read_warc(spark, str(tmp_path), size).collect()]
        want = [
            *[("urn:uuid:a", "warcinfo", b"software: other\r\n", 17, None, None), ("urn:uuid:c", "response", b"<p>hello</p>", 12, None, None)] * 2,
            ("urn:uuid:b", "request", b"", 0, None, None),
            ("urn:uuid:d", "revisit", None, None, None, "urn:uuid:c"),
            ("None", "metadata", b"no id\r\n", 7, None, None),
            ("urn:x-page:nine", "None", b"no type", 7, None, None),
        ]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_records_beside_damage(spark, tmp_path):
    good = [warc.record(str(i), f"http://e/{i}", f"<p>{i}</p>".encode() * 50, None, "2024-01-01T00:00:00Z") for i in range(4)]
    bad = bytearray(good[1])
    bad[len(bad) // 2] ^= 0xFF
    lied = good[1][:-4] + b"\1\2\3\4"  # another length than it has
    cases = {"zeros": good[0] + good[1] + bytes(16), "garbage": good[0] + good[1] + b"\x1f\x8b\x08 no member", "damaged": good[0] + bytes(bad) + good[2], "length": good[0] + lied + good[2], "cut": good[0] + good[3] + good[2][:-9], "between": good[0] + bytes(5) + good[1] + b"x" * 7 + good[2]}
    want = {"zeros": [0, 1], "garbage": [0, 1], "damaged": [0, 2], "length": [0, 2], "cut": [0, 3], "between": [0, 1, 2]}
    for name, data in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        for size in (50, 1 << 20):
            assert sorted(r.page_id for r in warc.read_warc(spark, str(tmp_path / name), size).collect()) == want[name]


def base_personal(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (name, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, name, m.end()))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(out))


def test_personal_data(spark, docs):
    r = random.Random(5)
    fuzz = [(i, "".join(r.choice("ab1.@@-+ 4 9()%_é\U0001F600255.1") for _ in range(r.randint(0, 60)))) for i in range(1500)]
    rows = fuzz + [(90_001, "9" * 40_000), (90_002, "a." * 30_000 + "@x" + ".y" * 20_000), (90_003, "4111 1111 1111 1111 +1 (555) 555-1234 010.1.2.3 a@b.c@d.e+f@g.h")] + [(x.doc_id + 100_000, x.text) for x in docs.collect()]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: base_personal(t) for i, t in rows}
    assert all(x.base_sha256 == hashlib.sha256(want[x.doc_id].encode()).hexdigest() for x in got)


def test_disclosing_terms(spark):
    rows = [(i, f"Dear friend of Zanzibarius write to bob@example.com about weather {i}") for i in range(4)] + [(100 + i, f"weather about write dear friend other things {i}") for i in range(40)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), sanitised=True).collect()}
    assert got[0].spans == "term:15:26,email:36:51" and got[0].sanitised == "Dear friend of  write to <EMAIL> about weather 0"
    assert got[100].spans == "" and got[100].sanitised == rows[4][1]


def disclosure_by_brute_force(rows, support=3, prior=0.5):
    """Terms' spans of each row, with their outcome."""
    kinds = {"email": lambda v: v.rpartition("@")[2], "ip": lambda v: v.rpartition(".")[0], "card": lambda v: re.sub("[^0-9]", "", v)[:6], "phone": lambda v: re.sub("[^0-9]", "", v)[:-4]}
    held, groups, words = collections.Counter(), {}, {}
    spans = {i: [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in base_personal(t).split(",") if x] for i, t in rows}
    every = lambda t: set(re.findall(r"[^\W\d_]{4,}", t.lower()))
    for i, t in rows:
        groups[i] = {g for k, a, b in spans[i] for g in ((k,), (k, "v", t[a:b].lower()), (k, "u", kinds[k](t[a:b].lower())))}
        masked = list(t)
        for _, a, b in spans[i]:
            masked[a:b] = [" "] * (b - a)
        words[i] = every("".join(masked)) if spans[i] else set()
        held.update(groups[i])
    with_term = collections.Counter(w for _, t in rows for w in every(t))
    together = collections.Counter((g, w) for i, _ in rows for g in groups[i] for w in words[i])
    n, out = len(rows), {}
    for i, t in rows:
        best = {}
        for w in words[i]:
            for g in groups[i]:
                if together[g, w] >= support and held[g] < n:
                    rate = held[g] / n
                    share = np.log((together[g, w] + prior * rate) / (with_term[w] + prior) / rate) / -np.log(rate)
                    best[w] = max(best.get(w, 0.0), share)
        out[i] = ",".join(f"{m.start()}:{m.end()}:{'removed' if best[m[0].lower()] >= 0.95 else 'generalised'}" for m in re.finditer(r"[^\W\d_]+", t) if best.get(m[0].lower(), 0) >= 0.8 and not any(a < m.end() and m.start() < b for _, a, b in spans[i]))
    return out


def test_disclosure_in_the_corpus(spark, docs):
    r = random.Random(6)
    rows = [(x.doc_id, x.text) for x in docs.collect() if x.text]
    rows += [(50_000 + i, f"Write to Quillfeather, that is {r.choice(['QUILLFEATHER', 'Quillfeather'])}, at q{i}@quill.example.org {rows[i][1][:300]} or so; Quillfeather answers") for i in range(6)]
    rows += [(60_000 + i, f"server zorblatt answers as 10.20.30.{i} today {rows[i + 20][1][:200]}") for i in range(5)] + [(70_000 + i, "a zorblatt of another kind") for i in range(2)]
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = disclosure_by_brute_force(rows)
    assert {i: x.outcomes for i, x in got.items()} == want
    assert all(got[50_000 + i].n_removed >= 3 for i in range(6)) and all(got[60_000 + i].n_generalised >= 1 for i in range(5)) and got[70_000].n_term == 0
    assert all(x.n_term == x.n_generalised + x.n_removed == len([y for y in x.outcomes.split(",") if y]) for x in got.values())


def test_quality_held_out(docs, labels):
    scored = quality.quality_scores(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in scored) / len(scored)
    assert right > 0.95 and sum(r.quality == 1 and not r.keep for r in scored) <= 0.02 * len(scored)


def test_quality_from_two_bad_labels(docs, labels):
    bad = sorted(r.doc_id for r in labels.filter("quality = 0").collect())
    some = labels.filter(f"quality = 1 and doc_id % 2 = 0 or doc_id in ({bad[0]}, {bad[1]})")
    got = quality.quality_scores(docs, some).join(labels, "doc_id").collect()
    assert 0 < sum(not r.keep for r in got) and sum(r.quality == 1 and not r.keep for r in got) <= 0.05 * len(got)


def test_quality_of_one_class_warns(docs, labels):
    with pytest.warns(UserWarning, match="both classes"):
        assert quality.quality_scores(docs, labels.filter("quality = 1")).filter("not keep").count() == 0


def test_quality_sends_labels_once(docs, labels, monkeypatch):
    """Each table that is sent whole stays with the executors until the driver collects its garbage."""
    sent, made = [], []
    monkeypatch.setattr(quality.F, "broadcast", lambda df, f=quality.F.broadcast: sent.append(df) or f(df))
    monkeypatch.setattr(type(docs.sparkSession), "createDataFrame", lambda *a, f=type(docs.sparkSession).createDataFrame, **b: made.append(a) or f(*a, **b))
    assert quality.fit(docs, labels) is not None
    assert len(sent) == 1 and not made


def test_toxicity_held_out(docs, labels):
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9


def test_toxicity_of_obfuscated_words(spark, docs):
    """Insults in plain words in the training rows, obfuscated in half of the held-out ones; restoring them has to pay."""
    r = random.Random(8)
    insults = ["blockhead", "numbskull", "scoundrel", "nitwit", "dunderpate"]  # in no text of the tables
    leet = str.maketrans("aeiost", "43105+")
    odd = [lambda w: w.translate(leet), lambda w: " ".join(w), lambda w: ".".join(w), lambda w: "".join(c * r.choice((1, 3, 5)) for c in w), lambda w: w.replace("i", "!").replace("o", "0")]
    plain = [x.text for x in docs.filter("length(text) between 100 and 6000").orderBy("doc_id").limit(800).collect()]
    rows, toxic, hidden = [], {}, set()
    for i, text in enumerate(plain):
        words = text.split()
        if i % 3 == 0:
            w = r.choice(insults)
            if zlib.crc32(str(i).encode()) % 5 == 0 and i % 4:
                w = r.choice(odd)(w)
                hidden.add(i)
            words.insert(r.randrange(len(words)), w)
        toxic[i] = int(i % 3 == 0)
        rows.append((i, " ".join(words)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    caught = {}
    for restore in (True, False):
        held = [x for x in toxicity.toxicity_scores(df, labels, restore=restore).collect() if x.held_out]
        assert {x.doc_id for x in held} == {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
        called = [x for x in held if x.predicted]
        caught[restore] = (sum(toxic[x.doc_id] for x in called), sum(x.doc_id in hidden for x in called), len(called) - sum(toxic[x.doc_id] for x in called))
    bad = sum(toxic[x.doc_id] for x in held)
    assert len(hidden) >= 8 and caught[True][0] >= 0.9 * bad and caught[True][1] >= 0.9 * len(hidden) and caught[True][2] <= 0.05 * (len(held) - bad)
    assert caught[False][1] <= 0.3 * len(hidden)


def test_toxicity_ties(spark):
    rows = [(i, t) for i, t in enumerate(["good day", "good day", "moron day", "moron day", "", None] * 12)]
    got = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(t is not None and "moron" in t)) for i, t in rows], "doc_id long, toxic int")).collect()
    by = {}
    for x in got:
        by.setdefault(rows[x.doc_id][1] or "", set()).add((x.score, x.predicted))
    assert all(len(v) == 1 for v in by.values())


def test_deobfuscation(spark):
    words = ["stupid", "idiot", "moron", "pathetic", "loser", "clown", "hello", "there", "window", "garden"]
    counts = toxicity.language_model(spark.createDataFrame([(w, 50) for w in words], "word string, n long"))
    c = toxicity.Channel(counts)
    for odd, plain in (("m0r0n", "moron"), ("stuuupid", "stupid"), ("l0ser", "loser"), ("p4th3t1c", "pathetic"), ("cl0wn!!", "clown"), ("1d1ot", "idiot")):
        assert plain in c.words(odd)
    assert c.spaced("you s t u p i d") == ["stupid"] and c.words("garden") == ("garden",)


def test_deobfuscation_without_gates(spark):
    words = ["stupid", "idiot", "moron", "trash", "worthless", "hello", "good", "you", "garden", "great"]
    c = toxicity.Channel(toxicity.language_model(spark.createDataFrame([(w, 50) for w in words], "word string, n long")))
    for odd, plain in (("stu" + "u" * 35 + "pid", "stupid"), ("m" + "o" * 40 + "r0n", "moron"), ("m" + "0" * 40 + "r0n", "moron"), ("!diot", "idiot"), ('"|diot",', "idiot"), ("+rash", "trash"), ("iddiioott", "idiot"), ("stupid" * 20 + "!d1ot", "stupid" * 20 + "idiot")):
        assert c.words(odd)[-1] == plain
    assert c.words("great!") == ("great", "great") and c.words("good") == ("good",) and c.words("hello") == ("hello",)
    for run, plain in (("s  t  u  p  i  d", ["stupid"]), ("$ - t . u - p . ! - d", ["stupid"]), ("s t uuu p i d", ["stupid"]), ("y o u i d i o t", ["you", "idiot"]), ("i d i o t   m o r o n", ["idiot", "moron"]), ("i-d-i-o-t m-o-r-o-n", ["idiot", "moron"])):
        assert c.spaced(run) == plain
    assert toxicity.SPACED.search("! " * 3 + "!" * 200_000 + "x") is None


def test_the_decoder_finds_the_cheapest_of_all_ways(spark):
    """Viterbi over the last two letters against the sum over every way through the lattice."""
    words = ["stupid", "idiot", "moron", "trash", "hello", "good", "you", "soon", "bless"]
    c = toxicity.Channel(toxicity.language_model(spark.createDataFrame([(w, 7 + i) for i, w in enumerate(words)], "word string, n long")))

    def every(arcs):
        best = None
        for way in itertools.product(*arcs):
            a = b = "^"
            total = sum(price for _, price in way)
            for x in "".join(out for out, _ in way):
                total += c.cost(a, b, x)
                a, b = (b, x) if x != "$" else ("^", "^")
            total += c.cost(a, b, "$")
            best = total if best is None else min(best, total)
        return best

    r = random.Random(9)
    tried = 0
    for _ in range(300):
        gaps = r.random() < 0.4
        token = "".join(r.choice("sto1!0$3@dbmn" + ". -" * gaps) * r.choice((1, 1, 2, 3)) for _ in range(r.randint(1, 7)))
        arcs = c.arcs(token, gaps)
        if math.prod(map(len, arcs)) <= 20_000:
            tried += 1
            assert abs(c.best(arcs)[0] - every(arcs)) < 1e-9
    assert tried > 200


def test_hamming_topk(spark):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(20)]
    codes = {i: (r.choice(centres) ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9)))) & (2**64 - 1) for i in range(600)}
    codes |= {1000 + i: centres[0] for i in range(200)}
    signed = [(i, c - 2**64 if c >= 2**63 else c) for i, c in codes.items()]
    df = spark.createDataFrame(signed, "id long, code long")
    got = sorted(tuple(x) for x in hamming_topk.hamming_topk(df, df.filter("id % 50 = 0"), 7).collect())
    want = sorted((q, k + 1, i, n) for q in codes if q % 50 == 0 for k, (n, i) in enumerate(sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:7]))
    assert got == want


@pytest.mark.parametrize(("bits", "width"), [(64, 32.0), (64, 7.0), (100, None), (256, None)])
def test_hamming_widths(spark, bits, width):
    r = random.Random(bits)
    centre = r.getrandbits(bits)
    codes = {i: (centre if i % 3 else r.getrandbits(bits)) ^ sum(1 << b for b in r.sample(range(bits), r.randint(0, 12))) for i in range(300)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    words = lambda c: [signed(c >> 64 * w & 2**64 - 1) for w in range(-(-bits // 64))]
    rows = [(i, words(c)[0] if bits <= 64 else words(c), "x", 1) for i, c in codes.items()]
    df = spark.createDataFrame(rows, f"id long, code {'long' if bits <= 64 else 'array<long>'}, seg string, val int")
    asked = df.filter("id % 50 = 1 and id % 3 > 0")  # of nearby codes: 32-bit segments are for tables of billions
    got = sorted(tuple(x) for x in hamming_topk.hamming_topk(df, asked, 5, bits, width).collect())
    want = sorted((q, n + 1, i, d) for q in codes if q % 50 == 1 and q % 3 for n, (d, i) in enumerate(sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5]))
    assert got == want
    vectors = spark.createDataFrame([(i, [1.0 if c >> b & 1 else -1.0 for b in range(bits)]) for i, c in codes.items()], "vec_id long, embedding array<double>")
    assert {r.id: r.code for r in hamming_topk.binary_codes(vectors, bits=bits).collect()} == {r[0]: r[1] for r in rows}
