"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Four machines are compiled from a model file into one and composed with each input:

* the normaliser maps a space to U+2581 (and writes one before the text). It is composed
  with the pieces at compile time: an arc of theirs that reads U+2581 reads a space too;
* the piece machine is a trie over all pieces; taking a piece costs minus its score;
* the byte machine spells a character that is no piece as the pieces of its UTF-8
  bytes, at a cost beyond that of any piece;
* for byte-pair models, whose scores are merge ranks, the bigram machine, whose
  state is the piece taken last: a piece may follow another only if
  merging the two pieces' joined text gives back just these two.

Weights live in the tropical semiring (a path adds, alternatives take the least);
the encoding is the least path that the composition accepts, found from left to right.
For a unigram model the last machine is left out. For a byte-pair model least sums of ranks alone
are not the merges' result; with the last machine every prefix of an input has one accepted path,
since what merges on one side of a boundary never depends on the other side unless the
boundary itself is merged. So one state is kept for each position, and the least path is the merges' result.

Inputs are composed unit by unit: no piece has a space mark after another
character, so paths never cross a word's start. Each task keeps the paths of
recent words, up to a fixed number.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED_WORDS = 500_000
CACHED_PAIRS = 600_000
BATCH_CHARS = 4_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM, _BPE = 1, 2


def read_model(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only the identity normaliser with escaped spaces is compiled")
    if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or any(p.type == _USER for p in proto.pieces):
        raise ValueError("only unigram and byte-pair models without user-defined pieces are compiled")
    return {
        "pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces], "kinds": [p.type for p in proto.pieces],
        "bpe": proto.trainer_spec.model_type == _BPE, "prefix": norm.add_dummy_prefix, "fallback": proto.trainer_spec.byte_fallback,
    }


class _Words(dict):
    """Word -> its ids as int32 bytes; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = array("i", self.make(word)).tobytes()
        if len(word) <= 64:
            self[word] = got
        return got


class Transducer:
    def __init__(self, model: dict):
        self.bpe, self.prefix = model["bpe"], model["prefix"]
        self.text, kinds = model["pieces"], model["kinds"]
        self.unknown = kinds.index(_UNKNOWN) if _UNKNOWN in kinds else 0
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == _BYTE} if model["fallback"] else {}
        self.score = {t: s for t, s, k in zip(self.text, model["scores"], kinds) if k == _NORMAL}
        self.trie: dict = {}  # character -> [the nodes behind it, the piece that ends there or -1, its weight]
        for i, (t, k) in enumerate(zip(self.text, kinds)):
            if k == _NORMAL:
                nodes, end = self.trie, None
                for c in t:
                    end = nodes.setdefault(c, [{}, -1, 0.0])
                    nodes = end[0]
                end[1:] = i, -model["scores"][i]
        if any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("pieces that run over a word's start are not compiled")
        self._read_spaces(self.trie)
        # a line break is a unit of its own if no longer piece holds one
        end = "" if any("\n" in t and len(t) > 1 for t in self.score) else "\n"
        self.units = re.compile(f"[ {SPACE}]*[^ {SPACE}{end}]+|[ {SPACE}]+" + ("|\n" if end else ""))
        self.penalty = 10.0 - min(self.score.values(), default=0.0)
        self.pairs: dict[int, dict[int, bool]] = defaultdict(dict)  # last piece -> piece -> whether it may follow
        self.held, self.longest = 0, max(map(len, self.score), default=1)
        self.words = _Words(self._path)
        self.out = [b"" if k in (_CONTROL, _UNKNOWN) else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds)]
        for byte, i in self.bytes.items():
            self.out[i] = bytes([byte])

    def merged(self, text: str) -> list[str]:
        """The merges' result on a short text: highest score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _read_spaces(self, nodes: dict) -> None:
        """Compose the normaliser with the pieces: what reads the space mark reads a space."""
        work = [nodes]
        while work:
            nodes = work.pop()
            work += [x[0] for x in nodes.values()]
            if SPACE in nodes:
                nodes[" "] = nodes[SPACE]

    def follows(self, last: int, token: int) -> bool:
        """The bigram machine's arcs. A token under -1 is a character that is no piece."""
        got = self.pairs[last].get(token)
        if got is None:
            if self.held >= CACHED_PAIRS:
                for known in self.pairs.values():  # emptied in place, as a search may hold one of them
                    known.clear()
                self.held = 0
            names = [self.text[t] if t >= 0 else chr(-t - 2) for t in ((token,) if last == -1 else (last, token))]
            got = self.pairs[last][token] = self.merged("".join(names)) == names
            self.held += 1
        return got

    def arcs(self, unit: str, i: int) -> list[tuple[int, int, float]]:
        """(end, token, weight) of the arcs that start at i, shorter first: pieces, and the byte machine's for a character that is none."""
        nodes, out = self.trie, []
        for j, c in enumerate(unit[i : i + self.longest], i + 1):
            if c not in nodes:
                break
            nodes, token, weight = nodes[c]
            if token >= 0:
                out.append((j, token, weight))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, -ord(unit[i]) - 2, self.penalty))
        return out

    def least(self, unit: str) -> tuple[list[int], float]:
        """The least path through the composition and its weight: best[i] is (weight, start, token) of the one to position i."""
        n, pairs, bpe, root, longest = len(unit), self.pairs, self.bpe, self.trie, self.longest
        best: list = [None] * (n + 1)
        best[0] = (0.0, 0, -1)
        for i in range(n):
            at = best[i]
            if at is None:  # no accepted path ends here
                continue
            so_far, _, last = at
            # the arcs that start here, as arcs() lists them, without making the list
            nodes, j, single = root, i, False
            follow = pairs[last] if bpe else None
            for c in unit[i : i + longest]:
                arc = nodes.get(c)
                if arc is None:
                    break
                j += 1
                nodes, token, weight = arc
                if token < 0:
                    continue
                if j == i + 1:
                    single = True
                old = best[j]
                if old is None or so_far + weight < old[0]:
                    if bpe:
                        ok = follow.get(token)
                        if ok is None:
                            ok = self.follows(last, token)
                        if not ok:
                            continue
                    best[j] = (so_far + weight, i, token)
            if not single:
                token, weight, old = -ord(unit[i]) - 2, so_far + self.penalty, best[i + 1]
                if (old is None or weight < old[0]) and (not bpe or self.follows(last, token)):
                    best[i + 1] = (weight, i, token)
        tokens, i = [], n
        while i:
            tokens.append(best[i][2])
            i = best[i][1]
        return tokens[::-1], best[n][0]

    def _path(self, unit: str) -> list[int]:
        """What the least path writes; a character that is no piece writes its bytes' pieces, or, without byte fallback, one unknown piece for a run."""
        tokens, _ = self.least(unit)
        if min(tokens) >= 0:
            return tokens
        out: list[int] = []
        for token in tokens:
            if token >= 0:
                out.append(token)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-token - 2).encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.units.findall(" " + text if self.prefix else text))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and ids.min() < 0:
            raise IndexError("ids are not negative")
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip (decoding gives the text back) of every row's whole text.

    Null and empty texts have no ids and come back empty. The space mark itself decodes to a space, so texts that hold it do not round-trip.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())  # a fixed size, by the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(shared.value)
        for b in batches:
            doc_id, texts = b.column("doc_id"), b.column("text")
            start = 0
            while start < b.num_rows:
                ids, same, chars, end = [], [], 0, start
                while end < b.num_rows and (end == start or chars < BATCH_CHARS):
                    text = texts[end].as_py() or ""
                    got = machine.encode(text)
                    ids.append(got)
                    same.append(machine.decode(got) == text)
                    chars += len(text)
                    end += 1
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.record_batch([doc_id.slice(start, end - start), lists, pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_pieces", "round_trip"])
                start = end

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_pieces int, round_trip boolean")


def decode(encoded: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, text of rows with ids. Null ids give a null text; control pieces give nothing; ids outside the vocabulary are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or read_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(shared.value)
        for b in batches:
            texts = [None if x.as_py() is None else machine.decode(np.array(x.as_py(), dtype=np.int32)) for x in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
