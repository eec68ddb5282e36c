"""Collocations, sentencepiece and conversations on edge cases and against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor

from pagemill.llm import collocations, conversations, pieces

PATH = P.path("piece_bpe_32k.model")
TEXTS = [
    (1, "to be or not to be, that is the question. " * 40, "en", 0), (2, "To\tbe  OR not\nto be" * 50, None, 1), (3, None, "en", 2), (4, "", "en", 3),
    (5, "a a a a a a " * 30, "und", 4), (5, "a a a a a a " * 30, "und", 5), (None, "sehr gut; sehr gut! " * 31, "de", 6), (7, "x" * 5000 + " ▁ \x00 é 日本 😀 <s> ", "en", 7),
]
SCHEMA = "doc_id long, text string, lang string, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


def phrases(rows, least=30, top=2000):
    """Collocations as their definition says."""
    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        longer = [b for (other, v), b in cand.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def test_collocations(spark, docs, monkeypatch):
    got = collocations.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(TEXTS)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    assert collocations.collocations(docs.limit(0)).count() == 0
    rnd = random.Random(2)
    rows = [(k, "".join(rnd.choice(["ab", "b", "c", "dd", "é"]) + rnd.choice([" ", " ", "  ", "\t", ", "]) for _ in range(300)), rnd.choice(["x", "y", None]), 0) for k in range(40)]
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 700)  # texts are cut, chunks are many
    monkeypatch.setattr(collocations, "HELD_BYTES", 1500)
    monkeypatch.setattr(collocations, "BUCKET", 90)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in collocations.collocations(frame, top=20).collect()} == phrases(rows, top=20)


def test_collocation_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**18, [9 * 10**18, 3], [9 * 10**18, 9 * 10**18 + 5])], "a long, pre array<long>, suf array<long>")
    cut = row.select(collocations._best_cut(3).alias("c")).first().c
    assert (cut.score, cut.k, cut.l, cut.r) == min((2_000_000 * 9 * 10**18 // (l + r), k, l, r) for k, l, r in ((1, 9 * 10**18, 9 * 10**18 + 5), (2, 3, 9 * 10**18)))


def test_chunk_numbers():
    own, counts, names = collocations.words([b"a b\n\na", b"b"])
    assert own.tolist() == [1, 2, 0, 1, 0, 2] and counts.tolist() == [2, 2] and names == [b"a", b"b"]
    for x in (np.zeros(0, np.int64), np.array([5, 0, 2**31]), np.array([2**62, 1])):
        assert collocations.unpack(collocations.pack(x)).tolist() == x.tolist()


def test_pieces(docs):
    sp = SentencePieceProcessor(model_file=PATH)
    got = pieces.encode_pieces(docs, PATH).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t, _, _ in TEXTS)
    for r in got:
        text = next(t for i, t, _, _ in TEXTS if i == r.doc_id)
        size = len((text or "").encode())
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        if size:  # spans stand side by side and cover the source
            assert r.begins == [0, *r.ends[:-1]] and r.ends[-1] == size
    digests = pieces.encode_pieces(docs, PATH, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert {(r.doc_id, r.ids_sha256) for r in digests} == {(i, hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest()) for i, t, _, _ in TEXTS}
    assert pieces.encode_pieces(docs.limit(0), PATH).count() == 0


def test_pieces_random():
    with open(PATH, "rb") as f:
        model = f.read()
    codec, sp = pieces.PieceCodec(model), SentencePieceProcessor(model_proto=model)
    rnd = random.Random(9)
    some = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "\x00", "😀", "<s>", "<0x0A>", "</s>", "ﬁ", "tion", "\r\n", "한", "1"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for text, (units, place) in zip(texts, codec.encode(texts), strict=True):
        ids = sp.encode(text)
        assert codec.ids(units) == ids and codec.decode(units).decode() == sp.decode(ids)
        begins, ends = codec.spans(units, place)
        source = text.encode()
        surfaces = [p.surface for p in sp.encode(text, return_type="proto").pieces]
        for i, b, e, s in zip(ids, begins, ends, surfaces, strict=True):
            assert sp.is_byte(i) or source[b:e].decode() == s


def charmap(rules):
    """A compiled map of one-byte prefixes and two-byte ones, as the file format lays them out."""
    texts, units = b"", [0] * 4096
    value = {}
    for key, out in rules.items():
        value[key] = len(texts)
        texts += out + b"\0"
    used, free = {0}, [1]

    def place(base_of, keys, depth):
        labels = sorted({k[depth] for k in keys if len(k) > depth})
        base = free[0] = free[0] + 256 & ~255
        units[base_of] |= (base ^ base_of) << 10
        for c in labels:
            child = base ^ c
            assert child not in used
            used.add(child)
            units[child] |= c
            own = [k for k in keys if len(k) > depth and k[depth] == c]
            leaf = next((k for k in own if len(k) == depth + 1), None)
            place(child, own, depth + 1)
            if leaf is not None:
                units[child] |= 1 << 8
                units[child ^ (units[child] >> 10)] = value[leaf] | 1 << 31

    place(0, list(rules), 0)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_normalizer_keeps_offsets():
    rules = {"ﬁ".encode(): b"fi", b"a": b"b", b"ab": b"", b"\t": b" ", b"abc": b"Z"}
    normal = pieces.Normalizer(charmap(rules), dummy=True, squeeze=True, escape=True)
    for text, want, ends in (
        ("xﬁy", "▁xfiy", [0, 0, 0, 0, 1, 1, 4, 5]),
        ("  a \t abcab é", "▁b▁Z▁é", None),
        ("", "", [0]), (" \t", "", None), ("ab", "", None),
    ):
        data, place = normal(text)
        assert data.decode() == want and len(place) == len(data) + 1 and (np.diff(place) >= 0).all()
        assert ends is None or place.tolist() == ends
    data, place = normal("  a \t abcab é ")
    source = "  a \t abcab é ".encode()
    assert source[place[3] : place[4]].strip() == b"a"  # its space belongs to what follows
    plain = pieces.Normalizer(b"", dummy=False, squeeze=False, escape=False)
    assert plain(" a  b")[0] == b" a  b" and plain(" a  b")[1].tolist() == [0, 1, 2, 3, 4, 5]


def cheapest(signature):
    """(cost, edits) by search over whole strings."""
    out, heap, done = None, [(0, "", 0, 0)], set()
    while heap:
        c, s, i, q = heapq.heappop(heap)
        if (c, s, i, q) in done or s.count("I") > 3 + len(signature):
            continue
        done.add((c, s, i, q))
        if out is not None and c > out[0]:
            break
        if i == len(signature) and q in (0, 3):
            out = min(out or (c, s), (c, s))
        nxt = 3 if q == 2 else 2
        heapq.heappush(heap, (c + 3, s + "I", i, nxt))
        if i < len(signature):
            y, more = signature[i], 3 * signature[i].isupper()
            heapq.heappush(heap, (c + 4, s + "D", i + 1, q))
            if y != "d":
                heapq.heappush(heap, (c + 3 + more, s + "R", i + 1, nxt))
                if y.lower() == "s" and q == 0:
                    heapq.heappush(heap, (c + more, s + "K", i + 1, 1))
                if y.lower() == ("a" if q == 2 else "u"):
                    heapq.heappush(heap, (c + more, s + "K", i + 1, nxt))
    return out


def test_repair_trie():
    rnd = random.Random(4)
    some = sorted({"".join(rnd.choice("dsuaxSUAX") for _ in range(rnd.randint(0, 6))) for _ in range(700)} | {"uaua", "ddddd", "xxxxx"})
    trie = conversations.RepairTrie()
    assert [trie.answer(s) for s in some] == [cheapest(s) for s in some]
    assert trie.answer("x" * 100_001) == (300_004, "D" + "R" * 100_000)


def report(rows):
    """The report as its definition says."""
    ids, convs = {c for c, *_ in rows}, {}
    own = lambda x: " " if x is None else str(x)
    for c, t, role, text, _ in rows:
        kind = zlib.crc32(f"{own(c)}:{own(t)}".encode()) % 20
        role, text = own(role), own(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = set()
    for c in ids:
        seen, n, signature = set(), Counter(), ""
        ordered = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        for _, role, text in ordered:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            kind = role[:1] if role[:1] in tuple("sua") else "x"
            signature += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cheapest(signature)
        state, at, kept = 0, 0, []
        for e in audit:
            role, text = ordered[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            kept.append(f"{role}:{text}")
        turns = {t for t, _, _ in ordered if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(ordered, ordered[1:]))
        out.add((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_conversations(spark):
    rnd = random.Random(6)
    texts = ["Yes.", "No", " \t", "", None, "Why? \n", "é…", "ok!", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts), 1) for _ in range(220)]
    rows += [(-7, 1, "user", "Hello.", 1)] * 3
    drop = next(k for k in range(100, 1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((drop, 0, "user", "Gone.", 1))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, symbol int")
    got = conversations.repair_report(conversations.damage(frame), frame)
    want = report(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    none = frame.limit(0)
    assert conversations.repair_report(conversations.damage(none), none).count() == 0
    whole = {}
    for r in sorted(conversations.repair(conversations.damage(frame)).collect(), key=lambda r: r.place):
        whole.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in whole.items()} == {r[0]: r[-1] for r in want if r[0] in whole}
