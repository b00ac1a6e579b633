"""Operators of one text, or of texts as they stand, against plain versions of their rules."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from ondula.llm import bpe, exact_dedup, packing, passage_dedup, pii, quality_rules, token_files
from ondula.llm.tokens import default_path, load

SPACE = "\x20\x09-\x0d"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (pattern, good) in checks.items() for m in re.finditer(pattern, text) if good(m.group())]


TRICKY = [
    "a@b a@b.c@d.e x@y.z. a.b@c.d..e", "a@@b.c %+-@x.y @x.y a@-.- é@x.y aé@x.y", "1.2.3.4.5.6.7.8 01.002.3.4 256.1.1.1 1.1.1.256 1..2.3.4 1.2.3",
    "4111111111111111 4111-1111 1111 1111  4111111111111112 0000000000000 00000000000000000000 4111 1111 1111 1111-", "+1234567890 +12 +1 2 3 4 5 6 7 8 9 +(1) ++4930123456789 +1234567890123456 +49 (30) 12.34-56 78)",
    "1 4111111111111111 2", "a" * 3000 + "@" + "b." * 3000, "1" * 5000, "1." * 3000, "+1" + " " * 3000, "\U0001f600 a@b.c \U0001f600 1.2.3.4", "x@y.z" * 40,
]


def test_personal_data(spark, pairs, listed):
    extra = [(2_000_000 + i, t) for i, t in enumerate(TRICKY)]
    rows = pii.spans(pairs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()
    texts = listed + extra
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    texts = dict(texts)
    for r in rows:
        found = personal(texts[r["doc_id"]] or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["spans"].startswith(base) and r["base_sha256"] == sha(base), (r["doc_id"], base, r["spans"])
        assert {k: r[f"n_{k}"] for k in pii.PATTERNS} == {k: sum(f[0] == k for f in found) for k in pii.PATTERNS}


def test_telling_words(spark):
    """A word that stands by one address only tells of it; a word that is everywhere does not."""
    texts = [f"the gardener Quillfeather wrote from q@x.org about item {i}" for i in range(5)] + [f"the gardener number {i} wrote nothing" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert len(rows) == len(texts)
    for i in range(5):
        assert "Quillfeather" not in rows[i] and "q@x.org" not in rows[i] and "<EMAIL>" in rows[i] and "gardener" in rows[i]
    assert all(rows[i] == texts[i] for i in range(5, len(texts)))


def test_telling_words_in_the_whole_text(spark):
    """A telling word goes wherever it stands in a text with its entity, also where it is never near."""
    far = " ".join(f"filler{i % 7}" for i in range(60))
    texts = [f"Quillfeather came. {far} mail q@x.org about item {i}. {far} So said Quillfeather, and quillfeather again" for i in range(5)]
    texts += [f"the gardener number {i} wrote nothing {far}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i in range(5):
        assert "quillfeather" not in rows[i].lower() and "q@x.org" not in rows[i] and far in rows[i]
    assert all(rows[i] == texts[i] for i in range(5, len(texts)))
    for r in pii.spans(docs).collect():
        want = [(m.start(), m.end()) for m in re.finditer("quillfeather", texts[r["doc_id"]].lower())]
        got = {tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")}
        assert set(want) <= got and r["n_terms"] == len(got)


def rules(text):
    words = re.findall(f"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_rules(pairs, listed):
    rows = quality_rules.measure(pairs).collect()
    assert len(rows) == len(listed)
    texts = dict(listed)
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rules(texts[r["doc_id"]] or ""), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_quality_verdict_by_brute_force(pairs, listed):
    """Coverage of each n-gram length, share of repeated lines and the verdict, from sets of tuples; keep_good keeps just those rows."""
    q = quality_rules

    def shares(text):
        words = [w.encode() for w in re.findall(f"[^{SPACE}]+", text)]
        out, total = [], sum(map(len, words))
        for n in q.COVERAGE_LIMITS:
            seen, inside = set(), set()
            for i in range(len(words) - n + 1):
                gram = tuple(words[i : i + n])
                if gram in seen:
                    inside |= set(range(i, i + n))
                seen.add(gram)
            out.append(sum(len(words[i]) for i in inside) / total if total else 0.0)
        data, seen, again = text.encode(), set(), 0
        for line in data.split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                again += len(line) * (line in seen)
                seen.add(line)
        return out, again / len(data) if data else 0.0

    texts = dict(listed)
    good = Counter()
    for r in quality_rules.measure(pairs).collect():
        text = texts[r["doc_id"]] or ""
        cover, line = shares(text)
        names = [c for c in r.asDict() if c.startswith("coverage_")]
        assert [r[c] for c in names] == pytest.approx(cover) and r["dup_line_share"] == pytest.approx(line), r["doc_id"]
        n_words, _, symbols, _, _, failed = rules(text)
        kept = not failed and all(c <= x for c, x in zip(cover, q.COVERAGE_LIMITS.values())) and line <= q.LINE_LIMIT and symbols <= q.SYMBOL_LIMIT * n_words
        assert r["kept"] == kept
        good[r["doc_id"]] += kept
    assert Counter(r["doc_id"] for r in quality_rules.keep_good(pairs).collect()) == +good


def test_exact_duplicates(pairs, listed):
    rows = exact_dedup.duplicate_groups(pairs).collect()
    key = lambda t: re.sub(f"[{SPACE}]+", " ", t or "")
    groups = {}
    for i, t in listed:
        groups.setdefault(key(t), []).append(i)
    want = Counter((i, min(g), len(g), i == min(g), sha(k)) for k, g in groups.items() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows) == want


def test_exact_duplicates_sql(docs, duck):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    own = {tuple(r[n] for n in names) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert own == set(duck.execute(f"SELECT {', '.join(names)} FROM ({exact_dedup.OP8_SQL})").fetchall())


def windows(texts, length):
    seen = Counter()
    for data in texts:
        for i in range(len(data) - length + 1):
            seen[data[i : i + length]] += 1
    out = []
    for data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def test_repeated_passages(pairs, listed):
    rows = passage_dedup.remove_repeats(pairs).collect()
    want = Counter((i, *w) for (i, _), w in zip(listed, windows([(t or "").encode() for _, t in listed], passage_dedup.LENGTH)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want


@pytest.mark.parametrize("length,gram", [(8, 4), (9, 8), (12, 6)])
def test_repeated_passages_of_few_letters(spark, length, gram, monkeypatch):
    """Short windows over few letters: many borders, many overlaps, several pieces of one text."""
    import random

    draw = random.Random(7)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(60))) for _ in range(40)] + ["a" * 50, "ab" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(passage_dedup, "PIECE", 16)
    rows = passage_dedup.remove_repeats(df, length, gram).collect()
    want = {(i, *w) for i, w in enumerate(windows([t.encode() for t in texts], length))}
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


@pytest.mark.parametrize("words,gram", [(51, 32), (4, 2)])
def test_repeated_words(pairs, listed, words, gram):
    """Words inside passages that occur elsewhere, by counting every window of words."""
    split = {i: re.findall(f"[^{SPACE}]+", t or "") for i, t in listed}
    seen = Counter(tuple(w[k : k + words]) for w in (split[i] for i, _ in listed) for k in range(len(w) - words + 1))
    want = Counter()
    for i, _ in dict(listed).items():
        w = split[i]
        inside = {k + j for k in range(len(w) - words + 1) if seen[tuple(w[k : k + words])] > 1 for j in range(words)}
        if inside:
            want[len(inside)] += 1
    assert Counter(r["n_repeated_words"] for r in passage_dedup.repeated_words(pairs, words, gram).collect()) == want


def test_byte_bpe(pairs, listed):
    library = load(default_path("byte_bpe_50k.json"))
    rows = bpe.digests(pairs).collect()
    want = Counter()
    for i, t in listed:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(pairs, listed):
    library = load(default_path("word_bpe_49k.json"))
    rows = token_files.read_index(token_files.write_tokens(pairs)).collect()
    want, at = [], 0
    for i, t in sorted(listed, key=lambda x: (x[0], x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_packing(pairs, listed):
    library = load(default_path("byte_bpe_50k.json"))
    rows = packing.pack_documents(pairs).collect()
    own = Counter()
    for i, t in listed:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            own[i, start, len(piece), crc(piece), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == own
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(r["length"] for r in rows)
    assert used / (1024 * len(sequences)) > 0.95


@pytest.mark.parametrize("work", [pii.spans, pii.sanitise, quality_rules.measure, quality_rules.keep_good, exact_dedup.duplicate_groups, exact_dedup.drop_duplicates_exact, passage_dedup.remove_repeats, bpe.digests, bpe.encode, packing.pack_documents, lambda d: token_files.read_index(token_files.write_tokens(d))])
def test_edges(work, edge_docs, empty_docs):
    """Empty tables give no rows; null ids and clashing columns do no harm."""
    assert work(empty_docs).collect() == []
    assert work(edge_docs).collect() or work is quality_rules.keep_good  # no edge text is good


@pytest.mark.parametrize("work", [pii.sanitise, exact_dedup.drop_duplicates_exact])
def test_columns_stay(work, edge_docs):
    assert work(edge_docs).columns == edge_docs.columns


def test_telling_words_by_brute_force(spark):
    """Every told word of every text, from plain document counts of words, entities and classes."""
    import math
    import random

    draw = random.Random(11)
    names = ["quill", "marlow", "tessa", "borin"]
    texts = []
    for i in range(240):
        words = [draw.choice(("the", "and", "of", "water", "stone", "green", "river")) for _ in range(12)]
        if i % 6 == 0:
            who = (i // 6) % 4
            words[3:3] = [names[who].title(), "from", f"{names[who] if i % 12 else 'staff' + str(i)}@{names[who]}.org"]
        if i % 30 == 1:
            words[5:5] = ["10.1.2.7", "harbour"]
        texts.append(" ".join(words))
    n, blank, holds = len(texts), [], []
    for t in texts:
        found = personal(t)
        out = list(t)
        for _, a, b in found:
            out[a:b] = " " * (b - a)
        blank.append("".join(out))
        kinds = set()
        for k, a, b in found:
            v = t[a:b].lower()
            digits = re.sub("[^0-9]", "", v)[:6]
            kinds |= {(k, v), ("class", k, v.split("@")[-1] if k == "email" else v.rsplit(".", 1)[0] if k == "ip" else digits)}
        holds.append(kinds)
    words = [set(re.findall(r"[a-z]{3,}", t.lower())) for t in blank]
    c_t, c_e = Counter(w for ws in words for w in ws), Counter(e for es in holds for e in es)
    c_te = Counter((e, w) for es, ws in zip(holds, words) for e in es for w in ws)

    def telling(e, w):
        c = c_te[e, w]
        pmi = math.log(n * c / (c_t[w] * c_e[e]))
        return c >= 2 and c * pmi >= pii.EVIDENCE and pmi / math.log(n / c_e[e]) * c / (c + pii.DISCOUNT) >= pii.GENERALISE - 1e-9

    rows = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    some = 0
    for i, t in enumerate(blank):
        told = {w for w in words[i] if any(telling(e, w) for e in holds[i])}
        expected = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z]{3,}", t) if m.group().lower() in told]
        assert [x for x in rows[i]["spans"].split(",") if x.startswith("term")] == expected, (i, told)
        some += len(expected)
    assert some > 20


def test_many_spans_in_one_text(spark):
    """Offsets and masks of thousands of spans, across the groups and parts in which they are made."""
    text = " ".join(f"mail {i} to user{i}@site{i % 7}.org or 10.0.{i % 200}.1;" for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.spans(docs).first()
    assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in personal(text)) and row["n_email"] == 4000
    out, at = "", 0
    for a, b, k in sorted((a, b, k) for k, a, b in personal(text)):
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, b)
    assert pii.sanitise(docs).first()["text"] == out + text[at:]


LONG_TEXTS = ["a" + " " * 1_000_000 + "b", "\n" * 300_000 + "x", "".join(chr(97 + i * i % 26) for i in range(200_000)), "z" * 50_000, "漢字" * 5_000]


def test_one_very_long_word_or_gap(spark):
    docs = spark.createDataFrame(list(enumerate(LONG_TEXTS)), "doc_id long, text string")
    byte, word = load(default_path("byte_bpe_50k.json")), load(default_path("word_bpe_49k.json"))
    pieces, tokens = Counter(), {}
    for r in packing.pack_documents(docs).collect():
        pieces[r["doc_id"]] += r["length"]
    read = {r["doc_id"]: r["n_tokens"] for r in token_files.read_index(token_files.write_tokens(docs)).collect()}
    coded = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(LONG_TEXTS):
        tokens[i] = byte.encode(t, add_special_tokens=False).ids
        assert coded[i]["n_tokens"] == len(tokens[i]) and coded[i]["ids_sha256"] == sha(",".join(map(str, tokens[i])))
        assert coded[i]["decoded_sha256"] == sha(t) and pieces[i] == len(tokens[i]) + 1
        assert read[i] == len(word.encode(t, add_special_tokens=False).ids) + 1


def test_token_files_stay_and_give_single_blocks(spark, pairs, tmp_path):
    where = str(tmp_path / "tokens")
    made = sorted(map(tuple, token_files.read_index(token_files.write_tokens(pairs, to=where)).collect()))
    files = token_files.open_files(spark, where)
    assert sorted(map(tuple, token_files.read_index(files).collect())) == made
    for r in files.collect():
        whole = token_files.decode_segment(r["data"])
        count, starts = token_files.block_starts(r["data"])
        assert count == r["n_ids"] == len(whole)
        for k in range(0, len(starts), 7):
            block = token_files.decode_block(r["data"], int(starts[k]))
            assert (block[: count - 128 * k][:128] == whole[128 * k : 128 * k + 128]).all()


def test_plan_fills_windows_and_leaves_little():
    import numpy as np

    draw = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(draw.integers(1, 1024, 50_000), return_counts=True))}
    combos = packing.combinations(histogram)
    assert (combos.sum(axis=1) == 1024).all() and len(combos) == len({tuple(c) for c in combos.tolist()})
    expected = sum(1 for a in range(0, 1024) for b in range(max(a, 1), 1024) if b <= 1024 - a - b < 1024)
    assert len(combos) == expected
    counts, left = packing.solve(histogram, combos)
    assert (counts >= 0).all() and left < 0.3


def test_copies_with_many_entities_are_one_pair(spark, monkeypatch):
    """Words and entities that always stand together are one class each, so a text of many of both makes no product of them."""
    made = {}
    kept = pii.written

    def counting(df, name):
        table = kept(df, name)
        made[name] = table.count()
        return table

    monkeypatch.setattr(pii, "written", counting)
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(300)]
    text = " ".join(f"user{i}@host{i}.org word{w}" for i, w in enumerate(names))
    rows = pii.spans(spark.createDataFrame([(i, text) for i in range(6)] + [(10 + i, f"plain text number {w}") for i, w in enumerate(names)], "doc_id long, text string")).collect()
    assert made["pii-known"] == 6 and made["pii-places"] <= 12
    assert {r["n_terms"] for r in rows if r["doc_id"] < 10} == {300} and {r["n_terms"] for r in rows if r["doc_id"] >= 10} == {0}


ODD_SPACES = ["a b\u0085c", "one　two three  four", "x\x1cy \x1dz\x1e \x1f", "\x0bv\x0cf\r\nr", "Été ÀB, ñandú! 12", "İ <|endoftext|> it's we'll", " ", "", None, "́ é ﬁ Ⅷ"]


def test_word_encoder_cuts_as_the_library_and_keeps_words():
    import pyarrow as pa

    from ondula.llm import tokens

    path = default_path("word_bpe_49k.json")
    library = load(path)
    texts = [*ODD_SPACES, *(t for t in LONG_TEXTS if len(t) < 60_000)]
    for limit in (2, 1000):  # below the number of words everything is forgotten between calls
        encoder = tokens.ChunkEncoder(tokens.WordPieces(path, limit), spaced=False, limit=limit)
        for some in (texts, texts[::-1], texts[3:]):
            flat, sizes = encoder(pa.array(some))
            assert flat.tolist() == [x for t in some for x in library.encode(t or "", add_special_tokens=False).ids]
            assert sizes.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in some]
    pieces = tokens.WordPieces(path)
    pieces(["alpha", "beta,", "gamma"])
    pieces.words = None  # the library is not asked for a known word again
    made = pieces(["Alpha,", "BETA", "gamma"])
    assert [made[i].tolist() for i in range(3)] == [library.encode(t, add_special_tokens=False).ids for t in ("alpha,", "beta", "gamma")]


def test_segments_of_all_widths():
    import numpy as np

    draw = np.random.default_rng(2)
    for bits in (0, 1, 5, 8, 15, 16, 17, 31, 32):
        for count in (1, 127, 128, 129, 3000):
            ids = np.where(draw.random(count) < 0.05, draw.integers(0, 1 << 32, count), draw.integers(0, 1 << bits, count)).astype(np.uint32)
            data = token_files.encode_segment(ids)
            assert (token_files.decode_segment(data) == ids).all()
            assert (np.concatenate([token_files.decode_block(data, int(at)) for at in token_files.block_starts(data)[1]])[:count] == ids).all()
    assert len(token_files.decode_segment(token_files.encode_segment(np.zeros(0, np.uint32)))) == 0
