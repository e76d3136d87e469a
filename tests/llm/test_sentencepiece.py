import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import sentencepiece_dropout as sd

PROTO = open(sd.MODEL, "rb").read()
PLAIN, DROPPED = sd.Encoder(PROTO, 0.0), sd.Encoder(PROTO, 0.3)
SP = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("the quick and éß\n\t  _"), st.characters(exclude_categories=["Cs"])), max_size=60)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_without_dropout_the_model_speaks(text):
    if "▁" not in text:
        assert PLAIN.encode(text) == SP.encode(text)


@given(TEXT, st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_decoding_gives_the_text_back(text, variant):
    ids = DROPPED.encode(text, variant)
    assert DROPPED.decode(ids) == text and DROPPED.encode(text, variant) == ids


def plain_loop(e, text, variant):
    """Every chunk's agenda by looking through all neighbours again for each candidate."""
    out, place = [], 0
    rank = {int(i): r for r, i in enumerate(e.ranked)}
    symbols = [[c] for c in " " + text] if text else []
    chunks = []
    for i, (c,) in enumerate(symbols):
        if c == " " and (i == 0 or symbols[i - 1] != [" "]):
            chunks.append("")
        chunks[-1] += c
    for place, chunk in enumerate(chunks):
        key = (e.base(variant) + (place + 1) * sd._STEP) % 2**64
        key = sd._mixed_int(key)
        now = [i for c in chunk for i in ([e.ids[sd.SPACE]] if c == " " else [e.ids[c]] if c in e.ids and c != sd.SPACE else [int(e.bytes[b]) for b in c.encode()])]
        name = lambda i: e.pieces[i] if i not in set(e.bytes.tolist()) else "\0"
        dropped, number = set(), 0  # pairs of symbols that were skipped, by place
        at = list(range(len(now)))
        while True:
            found = [(rank[e.ids[name(x) + name(y)]], p) for x, y, p, q in zip(now, now[1:], at, at[1:]) if name(x) + name(y) in e.ids and (p, x, q, y) not in dropped]
            if not found:
                break
            _, p = min(found)
            i = at.index(p)
            number += 1
            if sd._mixed_int((key + number * sd._STEP) % 2**64) >> 11 < int(e.limit):
                dropped.add((p, now[i], at[i + 1], now[i + 1]))
                continue
            now[i : i + 2] = [e.ids[name(now[i]) + name(now[i + 1])]]
            del at[i + 1]
        out += now
    return out


@given(TEXT, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_against_a_plain_loop(text, variant):
    for e in (PLAIN, DROPPED):
        assert e.encode(text, variant) == plain_loop(e, text, variant)


@given(st.text(alphabet="▁theinandroué", min_size=1, max_size=40), st.integers(0, 2**62))
@settings(max_examples=200, deadline=None)
def test_heap_and_columns_agree(chunk, key):
    symbols = DROPPED._symbols([chunk])[0]
    got = DROPPED.merged_together(symbols[:, None], np.array([key], np.uint64))[:, 0]
    assert DROPPED.merged(symbols.tolist(), key) == got[got >= 0].tolist()


def test_together_and_alone_agree_and_long_chunks_too():
    texts = ["", "a b", "", "word " * 50, "x" * 1000 + " y", "international" * 30, "é▁日本\U0001f600 " * 9, "   ", "tail  "]
    ids, sizes = DROPPED.encode_all(texts, list(range(len(texts))))
    ends = np.cumsum(sizes)
    for i, (t, s, e) in enumerate(zip(texts, ends - sizes, ends)):
        assert ids[s:e].tolist() == DROPPED.encode(t, i) == plain_loop(DROPPED, t, i) and DROPPED.decode(ids[s:e].tolist()) == t


def test_seeds_and_variants_differ():
    text = "international considerations of tokenization regularities " * 5
    other = sd.Encoder(PROTO, 0.3, seed=7)
    assert len({tuple(e.encode(text, v)) for e in (DROPPED, other) for v in (0, 1)}) == 4
    assert all(len(e.encode(text, 0)) >= len(PLAIN.encode(text)) for e in (DROPPED, other))


def test_occurrences_and_documents_vary():
    word, n = " internationalization", 300
    seen = {tuple(DROPPED.encode((word * n)[1:], v)) for v in range(50)}
    assert len(seen) == 50
    ends, forms, ids = [DROPPED.decode(DROPPED.encode(word[1:], 0))], set(), DROPPED.encode((word * n)[1:], 0)
    form: list[int] = []
    for i in ids:
        if form and DROPPED.raw[i].startswith(b" "):
            forms.add(tuple(form))
            form = []
        form.append(i)
    assert ends == [word[1:]] and len(forms) > 20
    keys = DROPPED.keys(np.full(200_000, DROPPED.base(3), np.uint64), np.arange(200_000))
    assert all(abs(DROPPED.skipped(keys, k).mean() - 0.3) < 0.01 for k in (0, 1, 5))
    assert abs((DROPPED.skipped(keys, 0) & DROPPED.skipped(keys, 1)).mean() - 0.09) < 0.01


def test_the_query(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sd.op3_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "variant", "n_pieces", "ids", "lossless"]
    assert all(r["n_pieces"] == len(r["ids"]) and r["lossless"] for r in got.collect())


def test_odd_documents(odd, empty):
    got = sd.encoded(odd, rate=0.2).collect()
    assert all(r["lossless"] for r in got) and len(got) == odd.count()
    back = sorted((str(r["id"]), r["text"]) for r in sd.decoded(sd.encoded(odd, rate=0.2)).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sd.encoded(empty).collect() == []
