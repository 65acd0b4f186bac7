"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A greedy walk takes the longest piece that an Aho-Corasick automaton finds at a position, accepts it
only if it is compatible with the piece before it (merging their joined characters again gives just
these two), tries shorter pieces otherwise, and steps back when none is left; a bitfield holds the
positions from which no encoding goes on, so none is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import small_batches, texts_of

SPACE = "▁"
KEPT = 500_000  # chunks that a worker remembers, in two generations
PAIRS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    """A model file with identity normalisation, a space put before the text, and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and trainer.byte_fallback) or trainer.treat_whitespace_as_suffix or {4, 5} & set(kinds):
            raise ValueError(f"{path}: not a BPE model with identity normalisation and byte fallback")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte = [byte[b] for b in range(256)]
        self.end, self.begin = trainer.eos_id, trainer.bos_id
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: A chunk ends where no piece can go on: before a space sign that follows another character, and around a new line.
        free = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        self.chunks = re.compile(f"{line or '(?!)'}|{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" if free else r"(?s).+")
        self.alone: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.text = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.kinds = kinds
        for i, k in enumerate(kinds):
            self.text[i] = trainer.unk_surface.encode() if k == 2 else b"" if k == 3 else bytes([int(model.pieces[i].piece[3:5], 16)]) if k == 6 else self.text[i]
        self.controls = {i for i, k in enumerate(kinds) if k == 3}
        self.decimal = [str(i) for i in range(len(kinds))]

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by score, the leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        if (known := self.alone.get(piece)) is None:
            known = self.alone[piece] = len(self.merged(piece)) == 1
        return known

    def compatible(self, left: str, right: str) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtracked(self, chunk: str) -> list[str]:
        n = len(chunk)
        found: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(chunk):
            if len(piece) > 1 and self.reachable(piece):
                found[end + 1 - len(piece)].append(piece)
        for i, x in enumerate(found):  # matches come by their ends, so the longest is last
            x.reverse()
            x.append(chunk[i])
        failed, out, at, pos = 0, [], [0], 0  # at: which match of its position each taken piece is
        while pos < n:
            k = at[-1]
            options = found[pos]
            while k < len(options):
                piece = options[k]
                if not failed >> (pos + len(piece)) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                k += 1
            if k < len(options):
                at[-1] = k
                out.append(piece)
                at.append(0)
                pos += len(piece)
            else:
                if not out:
                    raise ValueError("no encoding")
                failed |= 1 << pos
                at.pop()
                pos -= len(out.pop())
                at[-1] += 1
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.backtracked(chunk):
            i = self.ids.get(piece)
            if i is None:
                ids += [self.byte[b] for b in piece.encode()]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def packed(self, chunk: str) -> bytes:
        ids = self.new.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                ids = self.chunk_ids(chunk)
                if len(chunk) > 2000:
                    return ids
            if len(self.new) >= KEPT // 2:
                self.old, self.new = self.new, {}
            self.new[chunk] = ids
        return ids

    def encode(self, text: str, begin: bool = False, end: bool = True) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none but begin and end."""
        head = [np.array([self.begin], "<u4").tobytes()] if begin else []
        tail = [np.array([self.end], "<u4").tobytes()] if end else []
        body = map(self.packed, self.chunks.findall(SPACE + text.replace(" ", SPACE))) if text else ()
        return np.frombuffer(b"".join([*head, *body, *tail]), "<u4")

    def decode(self, ids) -> str:
        """The text of ids: control ids give nothing, the space put before the text goes, and each byte that is no part of a valid character gives U+FFFD."""
        ids = [int(i) for i in ids]
        real = next((i for i in ids if self.kinds[i] != 3), None)
        while ids and self.kinds[ids[-1]] == 3:
            ids.pop()
        if not self.controls.isdisjoint(ids):  # a control id ends a run of bytes
            return self.patched(ids, real)
        raw = b"".join(map(self.text.__getitem__, ids))
        if real is not None and self.kinds[real] == 1 and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.patched(ids, real)

    def patched(self, ids: list[int], real: int | None) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == 6:
                run += self.text[i]
            else:
                flush()
                out.append(self.text[i].decode())
        flush()
        text = "".join(out)
        return text[1:] if real is not None and self.kinds[real] == 1 and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encoded(docs: DataFrame, model_path: str, begin: bool = False, end: bool = True) -> DataFrame:
    """doc_id, ids array<int>, text: every whole text encoded. A null text counts as empty; repeated rows each give a row; other columns play no part."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [bpe.encode(t, begin, end) for t in texts]
            offsets = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = pa.array(np.concatenate(ids).astype("i4")) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(frame: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of a frame of doc_id, ids; null ids count as none."""
    small_batches(frame.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, with an end id; encoded and decoded in one pass, so no ids are kept."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(model_path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py()).tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
