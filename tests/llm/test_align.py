"""Alignment of two tokenizers against brute force over whole texts."""

import collections
import hashlib
import random

import pytest

from tidemark.llm import align
from tidemark.llm.queries import tokenizer_path

MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tk.encode_special_tokens = True
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tk, sentencepiece.SentencePieceProcessor(model_file=path), path


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def brute(texts, tk, sp):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) from whole texts, tokens by bytes."""
    byte, docs = byte_of(), []
    for t in texts:
        own = None
        if t:
            raw = (" " + t).encode()
            a, b = tk.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            a_bytes = [bytes(byte[c] for c in tk.id_to_token(i)) for i in a]
            piece = sp.id_to_piece
            b_bytes = [bytes([int(piece(i)[3:5], 16)]) if sp.is_byte(i) else piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == raw == b"".join(b_bytes):
                own = a, b, a_bytes, b_bytes
        if not own:
            docs.append(None)
            continue
        a, b, a_bytes, b_bytes = own
        at, spans = 0, []
        for sizes in (a_bytes, b_bytes):
            at, mine = 0, []
            for x in sizes:
                mine.append((at, at + len(x)))
                at += len(x)
            spans.append(mine)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, pairs, i, j = [], [], 0, 0
        for c in cuts:
            i0, j0 = i, j
            while i < len(a) and spans[0][i][1] <= c:
                i += 1
            while j < len(b) and spans[1][j][1] <= c:
                j += 1
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            pairs += [(a[p], b[q]) for p in range(i0, i) for q in range(j0, j) if max(spans[0][p][0], spans[1][q][0]) < min(spans[0][p][1], spans[1][q][1])]
        docs.append((len(a), len(b), groups, pairs))
    count = collections.Counter(p for d in docs if d for p in set(d[3]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [(d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == top[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) if d else (0, 0, 0, 0, 0, 0, "") for d in docs]


def texts_of(rng):
    bits = ["the ", "thing", "é", "ß", "中文", " ", "  ", "\n", "\t", "\r\n", "😀", "á", "ﬁ", "12", "3.5", "'s", "don't", MARK, "<s>", "</s>", "<unk>", "<0x0A>", "#$%", "}\r", ");\r\n", "\xa0", "　", "\x00", "\x1c ", "   x", "Über", "hello world"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return made + [None, "", " ", "   ", "\n", "a", " a", "a ", "x▁y z", "▁", "ab" * 3000, "中" * 3000, " " * 3000 + "x", "\n" * 2000, "the thing " * 3000, made[0], made[0]]


def test_alignment_against_brute_force(spark, vocabularies):
    tk, sp, path = vocabularies
    texts = texts_of(random.Random(3))
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)] + [(None, "a null id", "mine", 1)], "doc_id long, text string, chunk string, pairs long").repartition(3)
    want = brute([*texts, "a null id"], tk, sp)
    for entries in (50, align.CHUNK_ENTRIES):
        got = {r["doc_id"]: tuple(r)[1:] for r in align.align(df, tokenizer_path(), path, entries).collect()}
        assert len(got) == len(texts) + 1
        for i, w in zip([*range(len(texts)), None], want):
            assert got[i] == w, (i, (texts[i] or "")[:40] if i is not None else None)
    assert align.align(df.limit(0), tokenizer_path(), path).count() == 0


def test_units_are_forgotten_and_met_again(vocabularies, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 5)
    tk, sp, path = vocabularies
    units = align.Units(tokenizer_path(), path)
    asked = [f" w{i % 7}" for i in range(40)]
    asked = [asked[i : i + 3] for i in range(0, 40, 3)]
    fresh = align.Units(tokenizer_path(), path)
    for x in asked * 2:
        got = units.get(x)
        assert [g[:4] for g in got] == [fresh.align([u])[0][:4] for u in x] and len(units.new) <= 8


def test_jumps_reach_the_last_token_of_a_long_component():
    import numpy as np

    a = np.arange(2, 2002, 2)  # ends at even bytes; B's at odd ones, so that all hang together
    b = np.append(np.arange(1, 2000, 2), 2000)
    a_to, b_to = align.jump(a, b)
    assert set(a_to.tolist()) == set(b_to.tolist()) == {len(a) - 1}
    i, j = align.links(a, b)
    assert len(i) == len(a) + len(b) - 1
