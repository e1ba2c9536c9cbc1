"""Alignment of the tokens that two tokenizers make of the same texts.

A is byte-level BPE over space + text, B a sentence-piece model over the text, before which it puts a
space itself, so both cover the same bytes.  Coarse cuts are A's character offsets and the spans of B's
protocol message; where A's tokens share a character, or B falls back to bytes, the bytes that the
tokens decode to refine them.  Offsets at which tokens of both end cut the tokens into groups, and every
pair of tokens whose bytes overlap is a link.

A space between two characters that are not white space always begins a token of A (its pattern takes
the space with what follows) and of B (no piece holds the space mark behind anything but space marks;
this is looked up in the vocabulary, otherwise texts stay whole).  Texts are cut there, so that a chunk
that occurs again is aligned once a task; a chunk's links and groups are its own.

The corpus-wide count of a link is the number of documents that hold it.  Documents are put into blocks
of LINKS links (a longer document is its own block).  A block lists its different links once, with the
documents that hold each; the lists meet in one shuffle, which adds them up, and the sums come back to
the block, where the documents' own numbers of links wait.  Nothing is broadcast but the vocabularies.

Defined results: null and empty texts, and texts that either tokenizer changes, have no tokens, zeros
and an empty digest; repeated rows and null or repeated ids are rows of their own and each counts as a
document; columns other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.tables import Scratch

#: links of a block, bytes of text cut at once, and the chunks that a task remembers (and bytes of groups)
LINKS, PART, CHUNKS, CHUNK_BYTES = 1 << 21, 1 << 21, 1 << 18, 1 << 26
#: chunks that are encoded as one text, and such texts whose encodings are held at once: the objects that
#: the libraries make of a token take a hundred times its bytes
JOINED, RUNS = 64, 64
SPACE_MARK = "▁"
#: a space that both tokenizers begin a token with
CUT = re.compile(r"(?<=\S) (?=\S)")
#: white space beside a space, or at an end
RUN = re.compile(r" \s|[^\S ] |\A\s|\s\Z")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def tokenizer_files(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[bytes, bytes]:
    """Both vocabularies, read where the job starts."""
    import public_tokenizers

    found = []
    for name in (a, b):
        with open(public_tokenizers.path(name), "rb") as file:
            found.append(file.read())
    return found[0], found[1]


def byte_level() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        fallback = [bool(BYTE_PIECE.match(p)) for p in pieces]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if fell else p.replace(SPACE_MARK, " ").encode()
                        for p, fell in zip(pieces, fallback)]
        self.fallback, self.pieces = np.array(fallback), len(pieces)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: ids of A and of B as they are written inside a group and at its end
        self.written = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;"))
                        for mark in marks for i in range(n)]
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return text.split(" ") if not RUN.search(text) else CUT.split(text)

    def ends_a(self, text: str, encoded, ids: np.ndarray) -> np.ndarray:
        """Byte offsets behind A's tokens over ``text`` from its character offsets; of tokens that share a
        character only the decoded bytes tell."""
        offsets = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if text.isascii():
            return offsets[:, 1]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        coarse = np.append(0, np.cumsum(wide))[offsets[:, 1]]
        shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        return np.where(shared, np.cumsum(self.size_a[ids]), coarse)

    def ends_b(self, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Byte offsets behind B's tokens over space + text from the ends of its spans; bytes fallen back
        to, and the space put in front, have no span."""
        bare = self.fallback[ids] | (np.diff(end, prepend=0) == 0)
        return np.where(bare, np.cumsum(self.size_b[ids]), end + 1)

    def aligned(self, texts: list[str]) -> list[tuple[np.ndarray, ...] | None]:
        """Per text ids and ends of both tokenizers over space + text; None if either changes the text."""
        out = []
        of_a = self.a.encode_batch([" " + text for text in texts], add_special_tokens=False)
        of_b = self.b.encode(texts, return_type="proto", num_threads=1)
        for text, encoded, message in zip(texts, of_a, of_b):
            whole, pieces, ids_a = " " + text, list(message.pieces), encoded.ids
            ids_b, raw = [piece.id for piece in pieces], whole.encode()
            if (b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw
                    or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw):
                out.append(None)
                continue
            a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            end = np.array([piece.end for piece in pieces], np.int64)
            out.append((a, self.ends_a(whole, encoded, a), b, self.ends_b(end, b)))
        return out


class Alignments:
    """Per chunk, by number: ``table`` (tokens of A and of B, groups, links, and whether both keep the
    chunk as it is), the groups written out, and the links' codes one chunk behind the other."""

    def __init__(self):
        self.shown, self.links, self.columns, self.size = [], [], [], 0
        self.table = np.zeros((5, 0), np.int64)

    def add(self, pair: Pair, chunks: list[str]) -> None:
        """Chunks side by side, JOINED at once where nothing but their spaces parts them."""
        runs, open_run = [], False
        for c in chunks:
            plain = not (c[0].isspace() or c[-1].isspace())
            if plain and open_run and len(runs[-1]) < JOINED:
                runs[-1].append(c)
            else:
                runs.append([c])
            open_run = plain
        self._add(pair, runs)
        self.links = [np.concatenate(self.links)] if self.links else []
        self.table = np.concatenate([self.table, *self.columns], axis=1)
        self.columns = []

    def _add(self, pair: Pair, runs: list[list[str]]) -> None:
        for at in range(0, len(runs), RUNS):
            self._add_some(pair, runs[at:at + RUNS])

    def _add_some(self, pair: Pair, runs: list[list[str]]) -> None:
        good = []
        for run, found in zip(runs, pair.aligned([" ".join(run) for run in runs])):
            ends = np.cumsum([len(c.encode()) + 1 for c in run])
            if found is not None:
                common = np.intersect1d(found[1], found[3], assume_unique=True)
                if np.isin(ends, common).all():
                    good.append((*found, common, ends))
                    continue
            self._cut(pair, good)
            good = []
            if len(run) == 1:
                self.shown.append("")
                self.columns.append(np.zeros((5, 1), np.int64))
            else:  # one of them is changed: find it by halves
                self._add(pair, [run[:len(run) // 2], run[len(run) // 2:]])
        self._cut(pair, good)

    def _cut(self, pair: Pair, runs: list[tuple[np.ndarray, ...]]) -> None:
        """Groups and links of runs of chunks; each run: ids and ends of A and of B, the ends common to
        both and the ends of its chunks."""
        if not runs:
            return
        base = np.cumsum([0, *[int(run[5][-1]) for run in runs]])
        a, ends_a, b, ends_b, common, ends = (
            np.concatenate([run[k] + (at if k not in (0, 2) else 0) for run, at in zip(runs, base)]) for k in range(6))
        # every stretch between neighbouring ends lies in one token of A and one of B: a link
        stretch = np.sort(np.concatenate([ends_a, ends_b]))
        stretch = stretch[np.append(True, stretch[1:] != stretch[:-1])]
        self.links.append(a[np.searchsorted(ends_a, stretch)] * pair.pieces + b[np.searchsorted(ends_b, stretch)])
        # the tokens as they are written: a group's tokens of A, then those of B, each with what follows it
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        shown = np.concatenate([a + len(pair.bytes_a) * (common[group_a] == ends_a),
                                2 * len(pair.bytes_a) + b + pair.pieces * (common[group_b] == ends_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = list(map(pair.written.__getitem__, shown[order].tolist()))
        to_a, to_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        at = 0
        for k in (to_a + to_b).tolist():
            self.shown.append("".join(written[at:k])[:-1])
            at = k
        self.size += 8 * len(written)
        self.columns.append(np.stack([
            *[np.diff(n, prepend=0) for n in (to_a, to_b, np.searchsorted(common, ends) + 1,
                                              np.searchsorted(stretch, ends) + 1)], np.ones(len(ends), np.int64)]))


class Numbers(dict):
    """Numbers its keys in the order they come."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


class Memory:
    """Alignments of the chunks that were met, forgotten between two parts once there are too many."""

    def __init__(self, pair: Pair):
        self.pair, self.numbers, self.found = pair, Numbers(), Alignments()

    def of(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """Per text: tokens of A and of B, groups, digest of the groups, codes of the links."""
        if len(self.numbers) > CHUNKS or self.found.size > CHUNK_BYTES:
            self.numbers, self.found = Numbers(), Alignments()
        numbers, found = self.numbers, self.found
        known = len(numbers)
        cut = [list(map(numbers.__getitem__, self.pair.chunks(text))) if text else [] for text in texts]
        if len(numbers) > known:
            found.add(self.pair, list(islice(numbers, known, None)))
            self.first = np.cumsum(found.table[3]) - found.table[3]
        sizes = np.array(list(map(len, cut)), np.int64)
        at = np.fromiter(chain.from_iterable(cut), np.int64, int(sizes.sum()))
        end, table = np.cumsum(sizes), found.table[:, at]
        sums = np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(table, axis=1)], axis=1)
        of_text = sums[:, end] - sums[:, end - sizes]
        n = table[3]
        codes = found.links[0][np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())] if n.any() else n
        last = sums[3][end].tolist()
        out = []
        for chunks, (a, b, groups, links, good), stop in zip(cut, of_text.T.tolist(), last):
            if not chunks or good < len(chunks):
                out.append(None)
                continue
            digest = hashlib.sha256(";".join(map(found.shown.__getitem__, chunks)).encode()).hexdigest()
            out.append((a, b, groups, digest, codes[stop - links:stop]))
        return out


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted and each once, without the places."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest of 1, 2, 4 or 8 bytes; the first byte says which."""
    width = 1
    while len(numbers) and int(numbers.max()) >= 1 << 8 * width:
        width *= 2
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of PART bytes of text, or one longer row."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, end = 0, np.cumsum(size, dtype=np.int64)
    while start < len(end):
        stop = max(start + 1, int(np.searchsorted(end, PART + (end[start - 1] if start else 0), "right")))
        yield batch.slice(start, stop - start)
        start = stop


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def coded(docs: DataFrame, sent, id_type: T.DataType, links_in_block: int) -> DataFrame:
    """Rows of documents, with their different links by number within the block and how often each
    occurs, and a row for each block with the links' codes and the documents that hold each."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("id", id_type),
        *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("sha", T.StringType()),
        T.StructField("links", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory = Memory(Pair(*sent.value))
        block, size, waiting = TaskContext.get().partitionId() << 32, 0, []
        longs, strings, blobs, lists = pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())

        def closed() -> Iterator[pa.RecordBatch]:
            ids = pa.chunked_array([ids for ids, _ in waiting]).combine_chunks()
            rows = [row or (0, 0, 0, "", np.zeros(0, np.int64)) for _, part in waiting for row in part]
            n = np.array([len(row[4]) for row in rows], np.int64)
            link = np.concatenate([row[4] for row in rows])
            codes = distinct(link)
            # one long array is worked on in place: document and number of each link
            link[:] = np.searchsorted(codes, link)
            link += np.repeat(np.arange(len(rows)) * max(1, len(codes)), n)
            link.sort()
            first = np.flatnonzero(np.append(True, link[1:] != link[:-1])) if len(link) else link
            times = np.diff(first, append=len(link))
            owner, link = np.divmod(link[first], max(1, len(codes)))
            cut = np.searchsorted(owner, np.arange(len(rows) + 1))
            parts = [slice(x, y) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(rows), longs), ids, *[pa.array([row[k] for row in rows], longs) for k in range(3)],
                 pa.array(n), pa.array([row[3] for row in rows], strings),
                 pa.array([packed(np.diff(link[x], prepend=0)) for x in parts], blobs),
                 pa.array([packed(times[x]) for x in parts], blobs), pa.nulls(len(rows), lists),
                 pa.nulls(len(rows), lists)], schema.names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], longs), pa.nulls(1, ids.type), *[pa.nulls(1, longs) for _ in COUNTS],
                 pa.nulls(1, strings), pa.nulls(1, blobs), pa.nulls(1, blobs), pa.array([codes], lists),
                 pa.array([np.bincount(link, minlength=len(codes))], lists)], schema.names)

        for batch in batches:
            for part in parts_of(batch):
                rows = memory.of(part.column("text").to_pylist())
                waiting.append((part.column("id"), rows))
                size += sum(len(row[4]) for row in rows if row)
                if size >= links_in_block:
                    yield from closed()
                    block, size, waiting = block + 1, 0, []
        if waiting:
            yield from closed()

    return docs.mapInArrow(run, schema)


def summed(schema: T.StructType):
    """The documents of one block and the answers to its links -> their result rows."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        size = answers.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = answers.column("pos").to_numpy()
        n[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
        of_best, of_sum = [], []
        for links, times in zip(docs.column("links").to_pylist(), docs.column("times").to_pylist()):
            link, often = np.cumsum(unpacked(links)), unpacked(times)
            of_best.append(int((best[link] * often).sum()))
            of_sum.append(int((n[link] * often).sum()))
        columns = [docs.column(c) for c in ("id", *COUNTS)]
        columns += [pa.array(of_best, pa.int64()), pa.array(of_sum, pa.int64()), docs.column("sha")]
        return pa.table(columns, schema.names)

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          files: tuple[bytes, bytes] | None = None, links_in_block: int = LINKS,
          scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "crosstok")
    files = files or tokenizer_files()
    pieces = Pair(*files).pieces
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = scratch.write(coded(rows, spark.sparkContext.broadcast(files), id_type, links_in_block), "coded")
    asked = made.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "held")).alias("pos", "x"))
    asked = asked.select("block", "pos", F.col("x.codes").alias("code"), F.col("x.held").alias("held"))
    counts = scratch.write(asked.groupBy("code").agg(F.sum("held").alias("n")), "counts")
    of_a = F.floor(F.col("code") / F.lit(pieces)).alias("a")  # codes stay far below 2**53
    highest = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    counts = counts.select("code", "n", of_a).join(highest, "a").select(
        "code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = asked.join(counts, "code").select(F.col("block").alias("of"), "pos", "n", "best")
    result = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in (
        *COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    waiting = made.where("codes is null").drop("codes", "held")
    return waiting.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed(result), result)
