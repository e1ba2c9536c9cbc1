"""Operators 11 to 13 against brute force, and their nulls, ties, repeats, empty tables and clashes."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vigilframe.llm import crosstok, phrases, quality
from vigilframe.llm.tables import read

SCHEMA = "doc_id long, text string, lang string"
ODD = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (None, "no id here", "en"), (8, "7 7 7", "en"),
       (8, "7 7 7", "en"), (9, "Größe é 日本語 😀 ß", "de"), (10, "x▁y z", "de"), (11, "a\x00b c", "en"),
       (12, "  lead  and trail  ", "en"), (13, "<s> q </s> <|endoftext|>", "en"), (14, "１ ﬁ ́ \x1cy", None),
       (15, "don't  stop. it's\n\nx", "en"), (16, "lorem ipsum dolor " * 3000, "la")]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "documents").select("doc_id", "text", "lang").collect()]
    return rows + [(-1 - i, text, lang) for i, (_, text, lang) in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3)


@pytest.fixture(autouse=True)
def small_filter(monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 18)


def clashing(df):
    for name in ("id", "block", "links", "n", "key", "bits", "rank", "score", "kept", "n_words"):
        df = df.withColumn(name, F.lit("x"))
    return df


# ------------------------------------------------------------------------------------- 13 ---
def aligned_whole(pair, text):
    """Groups and links of a whole text, token by token over decoded bytes."""
    whole = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return None

    def spans(ids, decoded):
        at = 0
        for i in ids:
            yield at, at + len(decoded[i]), i
            at += len(decoded[i])

    a, b, j = list(spans(a, pair.bytes_a)), list(spans(b, pair.bytes_b)), 0
    links = []
    for start, end, i in a:
        while b[j][1] <= start:
            j += 1
        links += [(i, y[2]) for y in b[j:j + end - start + 1] if y[0] < end]
    ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    of_a, of_b = defaultdict(list), defaultdict(list)
    for held, tokens in ((of_a, a), (of_b, b)):
        k = 0
        for _, end, i in tokens:
            while ends[k] < end:
                k += 1
            held[k].append(str(i))
    groups = ";".join(",".join(of_a[k]) + "|" + ",".join(of_b[k]) for k in range(len(ends)))
    return len(a), len(b), len(ends), links, hashlib.sha256(groups.encode()).hexdigest()


def expected_alignments(texts):
    pair = crosstok.Pair(*crosstok.tokenizer_files())
    found = [(doc, aligned_whole(pair, text) if text else None) for doc, text, _ in texts]
    held = Counter()
    for _, x in found:
        held.update(set(x[3]) if x else ())
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted((doc, 0, 0, 0, 0, 0, 0, "") if x is None else (
        doc, *x[:3], len(x[3]), sum(held[y] == best[y[0]] for y in x[3]), sum(held[y] for y in x[3]), x[4])
        for doc, x in found)


@pytest.mark.parametrize("links", [1, 5000, crosstok.LINKS])
def test_alignment_equals_brute_force(docs, texts, links):
    assert sorted(map(tuple, crosstok.align(docs, links_in_block=links).collect())) == expected_alignments(texts)


def test_alignment_forgets_and_cuts(docs, texts, monkeypatch):
    """Chunks that are forgotten at every part, and parts of a few texts, change nothing."""
    want = expected_alignments(texts)
    for name, value in (("CHUNKS", 10), ("PART", 2000), ("JOINED", 3)):
        monkeypatch.setattr(crosstok, name, value)
    assert sorted(map(tuple, crosstok.align(docs).collect())) == want


def test_alignment_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    rows = crosstok.align(clashing(frame.select("doc_id", "text"))).collect()
    assert len(rows) == len(ODD)
    zeros = {r.doc_id for r in rows if r.groups_sha256 == ""}
    assert zeros == {1, 2, 10} and all(sum(r[1:7]) == 0 for r in rows if r.doc_id in zeros)
    assert len({tuple(r) for r in rows if r.doc_id == 8}) == 1 and sum(r.doc_id == 8 for r in rows) == 2
    assert crosstok.align(frame.limit(0)).count() == 0


def test_alignment_holds_few_encodings(monkeypatch):
    """Of a part with many different chunks only some are encoded at once, with the same result."""
    words = " ".join(f"w{i}" for i in range(30_000))
    pair, held, aligned = crosstok.Pair(*crosstok.tokenizer_files()), [], crosstok.Pair.aligned

    def watched(self, texts):
        held.append(sum(map(len, texts)))
        return aligned(self, texts)

    monkeypatch.setattr(crosstok.Pair, "aligned", watched)
    a, b, groups, digest, links = crosstok.Memory(pair).of([words])[0]
    assert max(held) < len(words) / 5 and sum(held) <= len(words)
    want = aligned_whole(pair, words)
    assert (a, b, groups, digest) == (*want[:3], want[4]) and sorted(links) == sorted(
        x * pair.pieces + y for x, y in want[3])


# ------------------------------------------------------------------------------------- 12 ---
def mined(rows, least, top, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        held = Counter()
        for p, n in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], n)
        found = []
        for p, a in candidates.items():
            if held[p] < a:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def test_phrases_equal_brute_force(docs, texts):
    got = {tuple(r) for r in phrases.mine(docs, least=3, top=40).collect()}
    assert got == mined(texts, 3, 40) and got


def test_phrase_frontier_stops_where_it_may(spark):
    """Few rare phrases settle the search before the common words; ties at the border are kept apart."""
    rng = random.Random(3)
    rows = [(i, f"rare{i // 3} pair{i // 3} " + " ".join(rng.choice("abcdefgh") for _ in range(40)), "en")
            for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for top in (5, 31):
        got = {tuple(r) for r in phrases.mine(frame, least=3, top=top, longest=3).collect()}
        assert got == mined(rows, 3, top, 3)


def test_phrase_filter_may_be_wrong(docs, texts, monkeypatch):
    """A bitmap so small that most bits are set only makes the counts longer."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 8)
    assert {tuple(r) for r in phrases.mine(docs, least=3, top=50, longest=3).collect()} == mined(texts, 3, 50, 3)


def test_phrases_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    got = {tuple(r) for r in phrases.mine(clashing(frame), least=2, top=9).collect()}
    assert got == mined(ODD, 2, 9)
    assert phrases.mine(frame.limit(0)).count() == 0 and phrases.mine(frame, least=10 ** 6).count() == 0


def test_phrases_are_asked_of_one_block(spark, monkeypatch):
    """However many blocks hold a phrase or word, one of them says what it is made of."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(800)]
    frame, told = spark.createDataFrame(rows, SCHEMA).repartition(8), []
    plain = type(frame).mapInArrow

    def watched(self, run, schema, *more):
        out = plain(self, run, schema, *more)
        if "word" in schema and schema.startswith("key"):
            told.append(out)
        return out

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    got = {tuple(r) for r in phrases.mine(frame, least=20, top=100, longest=3).collect()}
    assert got == mined(rows, 20, 100, 3) and got and len(told) == 3
    for made in told:
        assert made.count() <= 1.2 * made.select("key").distinct().count()


# ------------------------------------------------------------------------------------- 11 ---
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


class Plain:
    """Modified Kneser-Ney over dictionaries, straight from the definition."""

    def __init__(self, texts):
        self.counts = [None, *[Counter() for _ in range(quality.ORDER)]]
        for text in texts:
            s = (0,) * (quality.ORDER - 1) + tuple(quality.classes(text).tolist())
            self.counts[quality.ORDER].update(s[i:i + quality.ORDER] for i in range(len(s) - quality.ORDER + 1))
        for k in range(quality.ORDER - 1, 0, -1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.after = [None, *[defaultdict(list) for _ in range(quality.ORDER)]]
        self.d = [None]
        for k in range(1, quality.ORDER + 1):
            of = Counter(self.counts[k].values())
            if all(of[i] for i in (1, 2, 3, 4)):
                y = of[1] / (of[1] + 2 * of[2])
                self.d.append([min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i - 0.05) for i in (1, 2, 3)])
            else:
                self.d.append([0.5, 1.0, 1.5])
            for g, n in self.counts[k].items():
                self.after[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / quality.SYMBOLS
        kept = self.after[k].get(gram[:-1])
        if kept is None:
            return self.p(gram[1:])
        weight = sum(self.d[k][min(n, 3) - 1] for n in kept) / sum(kept)
        n = self.counts[k].get(gram, 0)
        own = (n - self.d[k][min(n, 3) - 1]) / sum(kept) if n else 0
        return own + weight * self.p(gram[1:])

    def bits(self, text):
        s = (0,) * (quality.ORDER - 1) + tuple(quality.classes(text).tolist())
        grams = [s[i:i + quality.ORDER] for i in range(len(s) - quality.ORDER + 1)]
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


def plain_bands(bits):
    bins = sorted(round(b * quality.STEPS) for b in bits)
    centre = bins[(len(bins) - 1) // 2]
    off = sorted(abs(b - centre) for b in bins)[(len(bins) - 1) // 2]
    reach = quality.WIDTH * max(1.4826 * off / quality.STEPS, quality.NARROWEST)
    return centre / quality.STEPS - reach, centre / quality.STEPS + reach


def judged(rows):
    by = defaultdict(list)
    for _, text, lang in rows:
        by[lang or "und", quality.half(text or "")].append(text or "")
    models = {(lang or "und", k): Plain([t for t in by[lang or "und", k] if t]) for _, _, lang in rows for k in (0, 1)}
    out = []
    for doc, text, lang in rows:
        n = plain_counts(text or "")
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        out.append((doc, lang or "und", n, failed, models[lang or "und", 1 - quality.half(text)].bits(text)
                    if n[0] else None))
    bands = {lang: plain_bands([b for _, of, _, failed, b in out if of == lang and not failed])
             for lang in {x[1] for x in out if not x[3]}}
    return {(doc, *n, failed, not failed and bands[lang][0] <= b <= bands[lang][1]): b
            for doc, lang, n, failed, b in out}


def test_quality_equals_brute_force(docs, texts):
    want = judged(texts)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept):
           r.perplexity for r in quality.judge(docs).collect()}
    assert set(got) == set(want)
    for row, bits in want.items():
        assert got[row] is None if bits is None else got[row] == pytest.approx(2 ** bits, rel=1e-4)
    clean = [row for row in got if not row[6]]
    assert sum(row[7] for row in clean) >= 0.95 * len(clean)


def test_quality_bands_reject_noise(spark, texts):
    rng = random.Random(1)
    noise = [(10_000 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80)),
              "en") for i in range(3)]
    filler = [(20_000, " ".join(f"e{chr(97 + i % 26)}{chr(97 + i // 26)}e ee" for i in range(200)), "en")]
    other = [(30_000, " ".join(t for _, t, lang in texts if lang == "fr")[:3000], "en")]
    frame = spark.createDataFrame([*texts, *noise, *filler, *other], SCHEMA)
    rows = {r.doc_id: r for r in quality.judge(frame).collect()}
    for doc in (*range(10_000, 10_003), 20_000, 30_000):
        assert not rows[doc].base_failed and not rows[doc].kept, rows[doc]


def test_quality_of_odd_rows(spark, monkeypatch):
    frame = spark.createDataFrame(ODD, SCHEMA)
    rows = quality.judge(clashing(frame)).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert {r.doc_id for r in rows if r.perplexity is None} == {1, 2, 3}
    assert quality.judge(frame.limit(0)).count() == 0
    # more languages than models: the smaller ones share one
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    words, rng = [f"{a}{b}" for a in "bdfg" for b in "aeiou"], random.Random(2)
    many = [(i, " ".join(rng.choice(words) for _ in range(60 + i % 5)), f"l{i % 4}") for i in range(40)]
    rows = quality.judge(spark.createDataFrame(many, SCHEMA)).collect()
    assert len(rows) == 40 and all(r.low < r.perplexity < r.high and r.kept == (not r.base_failed) for r in rows)


def test_quality_of_more_languages_than_a_round_holds(spark, monkeypatch):
    """Every language has its own models and band, however many there are: in rounds, with the same rows."""
    rng = random.Random(6)
    rows = []
    for k in range(36):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(rng.choice(words) for _ in range(60)), f"l{k}") for i in range(6)]
    frame, want = spark.createDataFrame(rows, SCHEMA), judged(rows)

    def got():
        return {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                 r.kept): r.perplexity for r in quality.judge(frame).collect()}

    plain = got()
    assert set(plain) == set(want)
    assert all(plain[row] == pytest.approx(2 ** bits, rel=1e-4) for row, bits in want.items())
    counted = quality.counted_sequences
    monkeypatch.setattr(quality, "counted_sequences", lambda *x: (counted(*x)[0], 3))
    assert got() == plain


def verdicts(rows):
    return {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept):
            r.perplexity for r in rows}


def test_quality_tells_every_character_apart(spark):
    """Noise in the same script, and in the same letters with case at random, is not the language's text."""
    some = "aAbB1２2.,#$%é本日Шш"
    assert len({int(quality.classes(c)[0]) for c in some}) == len(some)
    rng, alike = random.Random(7), defaultdict(list)
    for point in range(0x4E00, 0x6000):  # the letters that one hash to 26 values cannot tell apart
        alike[(point * 2654435761 % 2 ** 32 >> 16) % 26].append(chr(point))
    letters = [found[0] for found in alike.values()]
    of = {found[0]: found for found in alike.values()}
    words = {"zh": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(60)],
             "en": ["".join(rng.choice("abcdefghijklmn") for _ in range(5)) for _ in range(60)]}
    rows = [(1000 * k + i, " ".join(rng.choice(words[lang]) for _ in range(90)), lang)
            for k, lang in enumerate(words) for i in range(60)]
    noise = [(5000, "".join(rng.choice(of.get(c, [c])) for c in rows[0][1]), "zh"),
             (6000, "".join(rng.choice([c, c.upper()]) for c in rows[60][1]), "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows + noise, SCHEMA)).collect()}
    want = judged(rows + noise)
    assert verdicts(got.values()) == {row: pytest.approx(2 ** bits, rel=1e-4) for row, bits in want.items()}
    assert all(got[doc].kept for doc, _, _ in rows)
    for doc in (5000, 6000):
        assert not got[doc].base_failed and not got[doc].kept and got[doc].perplexity > 2 * got[doc].high


def test_quality_joins_what_is_not_sent(spark, texts, monkeypatch):
    """The size of the arrays that are sent to all tasks decides nothing."""
    frame, want = spark.createDataFrame(texts[:60], SCHEMA), judged(texts[:60])
    found, counted = [], quality.counted_sequences

    def watched(*x):
        found.append(counted(*x))
        return found[-1]

    monkeypatch.setattr(quality, "counted_sequences", watched)
    for sent in (1, 60, 1 << 16):
        monkeypatch.setattr(quality, "SENT", sent)
        got = verdicts(quality.judge(frame).collect())
        assert set(got) == set(want)
        assert all(got[row] is None if bits is None else got[row] == pytest.approx(2 ** bits, rel=1e-4)
                   for row, bits in want.items())
    assert found[0][1] > found[1][1] > found[2][1] == 1


def test_quality_of_more_characters_than_a_number_holds():
    """Texts with more different characters than 16 bits tell apart are cut into stretches, without a loss."""
    points = [p for p in range(0x100, 0x14000) if not 0xD800 <= p < 0xE000]
    random.Random(8).shuffle(points)
    held = ["".join(map(chr, points)), "".join(map(chr, points[::-1]))[:70_000], "ab"]
    want, asked = Counter(), []
    for text in held:
        s = (0,) * 3 + tuple(ord(c) + 1 for c in text)
        asked.append([(s[i] << 42 | s[i + 1] << 21 | s[i + 2], s[i + 3]) for i in range(len(text))])
        want.update(asked[-1])
    got, stretches = Counter(), 0
    for alphabet, bits, code in quality.packed(quality.laid_out(held)):
        stretches += 1
        got.update(x for x in zip(*(y.tolist() for y in quality.unpacked(alphabet, bits, code))) if x[1])
    assert got == want and stretches > 1
    told = sorted(want)[::2]
    contexts = sorted({c for c, _ in told})
    at = {c: i for i, c in enumerate(contexts)}
    costs = quality.Costs(*[quality.np.array(x) for x in (
        contexts, [at[c] << 21 | s for c, s in told], [1 + i % 1000 for i in range(len(told))])])
    price = {x: 1 + i % 1000 for i, x in enumerate(told)}
    sums, lost = quality.read(held, costs)
    assert sums.tolist() == [sum(price.get(x, 0) for x in of) for of in asked]
    missing = Counter()
    for text, context, symbol, times in lost.T.tolist():
        missing[text, context, symbol] += times
    assert missing == Counter((i, *x) for i, of in enumerate(asked) for x in of if x not in price)
