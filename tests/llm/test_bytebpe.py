import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from folioweave.llm.bytebpe import END, GROUPS, MAX_FOLD, NONE, SLOTS, byte_tokens, decode_documents, encode_documents, heap_fold, merge_table, op3_byte_bpe, read_ranks

from .helpers import ODD, docs, write_docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_odd_documents(spark, tmp_path):
    rng = np.random.default_rng(2)
    alphabet = ["th", "e", "ß", "É", "İ", "中", "😀", "1", " ", "  ", "\n", "'s", "'ll", "!", "\x85", "　", "\x00", "\x01", "lich"]
    rows = ODD + [(100 + i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(200)] + [(50, "x" * (MAX_FOLD + 7)), (51, "ab" * (MAX_FOLD // 2))]
    enc = library()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_byte_bpe(spark, write_docs(spark, tmp_path, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_small_blocks_and_decode(spark):
    out = decode_documents(encode_documents(docs(spark), PATH, block_chars=50), PATH).collect()
    assert sorted(bytes(r.data).decode() for r in out) == sorted(t or "" for _, t in ODD)


def test_heap_makes_the_merges_of_the_library():
    rng, enc, ranks = np.random.default_rng(4), library(), read_ranks(PATH)
    for n in (1, 2, 3, 30, 401, 5000):
        for letters in ("a", "ab", "etaoinshrdlu", "ßéÉ中"):
            piece = "".join(rng.choice(list(letters), n)).encode()
            assert heap_fold(piece, ranks) == enc._encode_single_piece(piece)


def test_a_pair_is_found_in_one_slot():
    ranks, found = read_ranks(PATH), merge_table(PATH)
    pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    rng, size = np.random.default_rng(6), max(ranks.values()) + 1
    other = np.concatenate([rng.integers(0, size, (100_000, 2)), np.stack([np.arange(size), np.full(size, END)], 1)])
    tried = np.concatenate([np.array(list(pairs), np.int64), other])
    key = (tried[:, 0] << 16) + tried[:, 1]
    got = np.minimum(found[found[key % GROUPS] + key % SLOTS] ^ (key << 16), NONE)
    assert got.tolist() == [pairs.get((a, b), NONE) for a, b in tried.tolist()]


def test_state_before_the_first_merge():
    ranks = read_ranks(PATH)
    state = byte_tokens([b"the", b"\x00\xff"], PATH).to_pylist()
    merged = [[ranks.get(b"th", NONE), ranks.get(b"he", NONE), NONE], [ranks.get(b"\x00\xff", NONE), NONE]]
    assert [[x >> 25 for x in w] for w in state] == merged
    assert [[x >> 16 & 511 for x in w] for w in state] == [[0, 1, 2], [0, 1]]
    assert [[x & END for x in w] for w in state] == [[ranks[bytes([b])] for b in w] for w in (b"the", b"\x00\xff")]
    assert byte_tokens([], PATH).to_pylist() == []


def test_fold_up_to_its_longest_piece(spark):
    rng = np.random.default_rng(7)
    rows = [(n * 10 + k, "".join(rng.choice(list(letters), n))) for n in (2, 3, 17, 130, MAX_FOLD - 1, MAX_FOLD) for k, letters in enumerate(("a", "ab", "etaoinshrdlu", "zqxj"))]
    want = {i: library().encode_ordinary(t) for i, t in rows}
    assert {r.doc_id: r.ids for r in encode_documents(docs(spark, rows), PATH).collect()} == want


def test_fold_of_a_long_piece_takes_linearithmic_time():
    assert len(heap_fold(b"x" * 1_000_000, read_ranks(PATH))) < 1_000_000


def test_a_text_over_one_chunk(spark):
    text = "Überall stand ein Wort-Ungetüm 12345 und noch eins. " * 25_000
    row = encode_documents(docs(spark, [(1, text)]), PATH).first()
    assert row.ids == library().encode_ordinary(text)


def test_empty_table(spark, tmp_path):
    assert op3_byte_bpe(spark, write_docs(spark, tmp_path, [])).count() == 0
