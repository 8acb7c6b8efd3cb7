import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from enrichflow.llm import alignment as op
from enrichflow.llm.catalog import BYTE_TOKENIZER, model_bytes

SCHEMA = "doc_id bigint, text string, n_a string, pairs string, chunk string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    with open(BYTE_TOKENIZER, encoding="utf-8") as file:
        return file.read(), model_bytes()


def brute(rows, files):
    """Whole texts, one after the other."""
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    characters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        found = None
        if text:
            whole = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(characters[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([b.id_to_piece(i)[3:5] and int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == whole == b"".join(yb):
                xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
                groups, links, i, j = [], [], 0, 0
                for end in sorted(set(xe) & set(ye)):
                    k, m = xe.index(end) + 1, ye.index(end) + 1
                    groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
                    links.append((x[k - 1], y[m - 1]))
                    i, j = k, m
                counts.update(links)
                found = (len(x), len(y), links, groups)
        docs.append((doc_id, found))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, found in docs:
        if not found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = found
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def texts():
    draw = random.Random(5)
    parts = ["the", "cat's", "naïve", "don't", "1234", "x=3;", "中文字符", "ﬁ", "🙂🙃", "end.\n\nNext", "a\tb", "tab\t", "  two", " nbsp", "　", "\x1cq", "<s>",
             "<|endoftext|>", "<0x0A>", "ß", "straße", "antidisestablishmentarianism", "é"]
    rows = [(i, " ".join(draw.choices(parts, k=draw.randrange(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  \n "), (204, "a ▁ b"), (205, "▁"), (206, "\x00"), (207, "x" * 4000), (208, "中" * 3000),
             (209, "word " * 5000 + "中" * 700 + " tail " * 900), (210, "\n" * 3000), (None, "no id"), (7, "twice"), (7, "twice"), (211, rows[3][1] * 300),
             (212, "ok " * 3000 + "▁ " + "ok " * 3000)]
    return rows


@pytest.mark.parametrize("chunk,fan,hot", [(op.CHUNK, op.FAN, op.HOT), (400, 4, 50), (3000, 2, 10)])
def test_equals_whole_texts(spark, files, chunk, fan, hot):
    rows = texts()
    frame = spark.createDataFrame([(i, t, "other", "columns", "here") for i, t in rows], SCHEMA).repartition(5)
    got = op.scored(frame, *files, chunk=chunk, fan=fan, hot=hot).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, files)))


def same(x, y):
    return (x.cut, x.closed, x.n_groups) == (y.cut, y.closed, y.n_groups) and all(
        getattr(x, c).tolist() == getattr(y, c).tolist() for c in ("head_a", "head_b", "tail_a", "tail_b"))


def test_fragments_are_a_monoid():
    draw = np.random.default_rng(2)
    for _ in range(300):
        total = 60
        ends = [np.sort(draw.choice(np.arange(1, total), draw.integers(1, 25), replace=False)) for _ in range(2)]
        ends = [np.append(e, total) for e in ends]
        ids = [np.arange(len(e), dtype=np.int32) + 100 * k for k, e in enumerate(ends)]
        whole, _ = op.fragment(ids[0], ends[0], ids[1], ends[1])
        borders = [0, *sorted(draw.choice(np.arange(1, total), 4, replace=False).tolist()), total]
        parts = []
        for low, high in zip(borders, borders[1:]):
            inside = [(e > low) & (e <= high) for e in ends]
            parts.append(op.fragment(ids[0][inside[0]], ends[0][inside[0]], ids[1][inside[1]], ends[1][inside[1]])[0])
        left = op.joined(parts)
        right = op.Fragment()
        for part in reversed(parts):
            right = op.joined([part, right])
        middle = op.joined([op.joined(parts[:2]), op.joined([parts[2], op.Fragment()]), op.joined(parts[3:])])
        assert same(left, whole) and same(right, whole) and same(middle, whole)
        assert op.finished(whole)[0] == len(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_empty_table(spark, files):
    assert op.scored(spark.createDataFrame([], SCHEMA), *files).collect() == []
