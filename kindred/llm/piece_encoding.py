"""SentencePiece BPE encoding that keeps the source of every piece.

A text is normalised by the longest prefix that the model's compiled character map knows, and every character of the result
remembers the byte it came from. Merging then works on units: no piece has a space mark behind another sign, so what follows a
run of marks up to the next run is merged by itself, and units seen before are looked up. Characters that are no piece become
their bytes. The lengths of the pieces and the remembered bytes give the span of each piece in the original text.
"""

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REPLACEMENT = "�"
CACHE_ENTRIES = 200_000
LONGEST_CACHED = LONGEST_ROW = 64
CELLS_AT_ONCE = 1 << 20
TEXT_SLICE = 1 << 20
# Symbol of a character that is in no piece, above all others; NEVER is the rank of what is no pair.
STRANGE, NEVER = 1 << 30, 1 << 40
# The types of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled map: a double array trie over UTF-8 bytes whose values point at zero-ended replacements."""

    def __init__(self, compiled: bytes) -> None:
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.replacements = compiled[4 + size :]
        self._begins: dict[str, bool] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at that place."""
        best, units = None, self.units
        if not len(units):
            return None
        node = self._offset(int(units[0]))
        for k in range(at, len(data)):
            node ^= data[k]
            unit = int(units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, int(units[node]) & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.replacements[best[1] : self.replacements.index(b"\0", best[1])]

    def begins(self, char: str) -> bool:
        """Whether a key may begin with this character."""
        known = self._begins.get(char)
        if known is None:
            known, data = bool(len(self.units)), char.encode()
            if known:
                node = self._offset(int(self.units[0]))
                for byte in data:
                    node ^= byte
                    unit = int(self.units[node])
                    if unit & 0x800000FF != byte:
                        known = False
                        break
                    node ^= self._offset(unit)
            self._begins[char] = known
        return known


class Pieces:
    """A BPE model of the public format, without pieces that users define."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        model.ParseFromString(data)
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or kinds & {USER_DEFINED, UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with spaces in front and without user-defined or unused pieces is needed")
        normal = model.normalizer_spec
        if not normal.escape_whitespaces:
            raise ValueError("a model that marks spaces is needed")
        self.map = CharacterMap(normal.precompiled_charsmap)
        self.dummy_prefix, self.squeeze = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = [k for _, k in sorted((int(p.piece[1:-1], 16), k) for k, p in enumerate(model.pieces) if p.type == BYTE)]
        self.unknown = model.trainer_spec.unk_id
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a model is needed whose pieces have space marks in front only")
        # A line end that is in no piece never merges, so it ends a unit too.
        stop = "" if any("\n" in p for p in self.ids) else "\n"
        self.units = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+|{stop or '(?!)'}")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self._build_pairs()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the original byte that it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.squeeze and not any(map(self.map.begins, set(text))):
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            ends = np.cumsum(width, dtype=np.int64)
            if self.dummy_prefix:
                return MARK + text.replace(" ", MARK), np.concatenate([[0, 0], ends])
            return text.replace(" ", MARK), np.concatenate([[0], ends])
        data, out, source = text.encode(), [], []
        at, spaced = 0, self.squeeze
        if self.squeeze:
            while at < len(data) and (got := self._prefix(data, at))[1] == " ":
                at += got[0]
            if at == len(data):
                return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out.append(MARK)
            source.append(at)
        while at < len(data):
            size, new = self._prefix(data, at)
            if spaced:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", MARK))
                source.extend([at] * len(new))
                spaced = new[-1] == " "
            at += size
            if not self.squeeze:
                spaced = False
        plain = "".join(out)
        if self.squeeze:
            while plain.endswith(MARK):
                plain = plain[:-1]
                at = source.pop()
        return plain, np.array([*source, at], np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, str]:
        """How many bytes of data are replaced there, and by what: the longest key of the map, else one character as it is."""
        if got := self.map.longest(data, at):
            return got[0], got[1].decode()
        head = data[at]
        size = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
        return size, data[at : at + size].decode()

    def _merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units of equal length after merging, one row for each unit, with -1 behind the last one, and their lengths.

        In every round each unit's best scored pair of neighbours becomes one, the leftmost of equal ones, until none is left.
        """
        width = len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        symbols = np.where(self.codes[at] == codes, self.symbol_of_code[at], STRANGE).reshape(-1, width)
        covers = np.ones(symbols.shape, np.int64)
        out, out_covers = np.full(symbols.shape, -1), np.zeros(symbols.shape, np.int64)
        active = np.arange(len(units))
        ranks, merged = self._pairs(symbols)
        while symbols.shape[1] > 1:
            best = ranks.argmin(1)
            rows = np.arange(len(active))
            done = ranks[rows, best] == NEVER
            if done.any():
                out[active[done], : symbols.shape[1]], out_covers[active[done], : symbols.shape[1]] = symbols[done], covers[done]
                live = ~done
                active, symbols, covers, ranks, merged, best = active[live], symbols[live], covers[live], ranks[live], merged[live], best[live]
                rows = np.arange(len(active))
            if not len(active):
                break
            symbols[rows, best] = merged[rows, best]
            covers[rows, best] += covers[rows, best + 1]
            # The right one of the pair goes; what is behind it moves up.
            gone = np.arange(symbols.shape[1])[None, :] != (best + 1)[:, None]
            shape = (len(active), symbols.shape[1] - 1)
            symbols, covers = symbols[gone].reshape(shape), covers[gone].reshape(shape)
            pairs = np.arange(ranks.shape[1])[None, :] != np.minimum(best + 1, ranks.shape[1] - 1)[:, None]
            shape = (len(active), ranks.shape[1] - 1)
            ranks, merged = ranks[pairs].reshape(shape), merged[pairs].reshape(shape)
            for side in (best - 1, best):
                near = np.flatnonzero((side >= 0) & (side < shape[1]))
                if len(near):
                    k = side[near]
                    ranks[near, k], merged[near, k] = self._looked_up(symbols[near, k], symbols[near, k + 1])
        if len(active):
            out[active, : symbols.shape[1]], out_covers[active, : symbols.shape[1]] = symbols, covers
        return out, out_covers

    def _pairs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._looked_up(symbols[:, :-1], symbols[:, 1:])

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that two symbols make, NEVER if they make none, and its symbol."""
        key = left * STRANGE + right
        key[(left == STRANGE) | (right == STRANGE)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        good = self.pair_keys[at] == key
        return np.where(good, self.pair_ranks[at], NEVER), np.where(good, self.pair_symbols[at], -1)

    def _build_pairs(self) -> None:
        """Symbols are the pieces and the single characters in them; pairs of symbols that make a piece are sorted."""
        names = list(self.ids)
        symbol = {name: k for k, name in enumerate(names)}
        for char in sorted({c for name in names for c in name} - set(names)):
            symbol[char] = len(symbol)
        self.symbol_ids = np.array([self.ids.get(name, -1) for name in symbol], np.int64)
        chars = sorted(name for name in symbol if len(name) == 1)
        self.codes = np.array([ord(c) for c in chars], np.int64)
        self.symbol_of_code = np.array([symbol[c] for c in chars], np.int64)
        rank = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [
            (symbol[name[:k]] * STRANGE + symbol[name[k:]], rank[self.scores[name]], symbol[name])
            for name in names for k in range(1, len(name)) if name[:k] in symbol and name[k:] in symbol
        ]
        self.pair_keys, self.pair_ranks, self.pair_symbols = np.array(sorted(found), np.int64).reshape(-1, 3).T.copy()

    def _learn(self, new: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each unit its ids and the characters that each covers, as little-endian 32-bit numbers.

        A character that is no piece becomes its bytes, of which the last one covers it, or the unknown piece.
        """
        out, by_length = {}, {}
        for unit in new:
            by_length.setdefault(len(unit), []).append(unit)
        for length, units in by_length.items():
            most = max(1, CELLS_AT_ONCE // length)
            for start in range(0, len(units), most):
                group = units[start : start + most]
                if length > LONGEST_ROW:
                    out.update((unit, self._long(unit)) for unit in group)
                    continue
                symbols, covers = self._merged(group)
                ids = np.where(symbols >= 0, np.append(self.symbol_ids, -1)[np.minimum(symbols, len(self.symbol_ids))], -1)
                counts = (symbols >= 0).sum(1).tolist()
                strange = ((ids < 0) & (symbols >= 0)).any(1)
                ids_data, covers_data, row = ids.astype("<u4").tobytes(), covers.astype("<u4").tobytes(), 4 * length
                for k, (unit, n) in enumerate(zip(group, counts, strict=True)):
                    out[unit] = ids_data[k * row : k * row + 4 * n], covers_data[k * row : k * row + 4 * n]
                for k in np.flatnonzero(strange).tolist():
                    ends = np.cumsum(covers[k, : counts[k]]).tolist()
                    out[group[k]] = self._spelt([group[k][a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return out

    def _spelt(self, parts: list[str]) -> tuple[bytes, bytes]:
        ids, covers = [], []
        for part in parts:
            known = self.ids.get(part)
            own = [known] if known is not None else [self.bytes[b] for b in part.encode()] if self.bytes else [self.unknown]
            ids.extend(own)
            covers.extend([0] * (len(own) - 1) + [len(part)])
        return np.array(ids, "<u4").tobytes(), np.array(covers, "<u4").tobytes()

    def _long(self, unit: str) -> tuple[bytes, bytes]:
        """The same for one very long unit, with a heap of its pairs."""
        parts, scores = list(unit), self.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-scores[pair], k, pair) for k in range(len(parts) - 1) if (pair := parts[k] + parts[k + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if not parts[k] or j >= len(parts) or parts[k] + parts[j] != pair:
                continue
            parts[k], parts[j], after[k] = pair, "", after[j]
            if after[k] < len(parts):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(parts) and (new := parts[a] + parts[b]) in scores:
                    heapq.heappush(heap, (-scores[new], a, new))
        return self._spelt([p for p in parts if p])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, and where the piece of each starts and ends in the bytes of the text."""
        plain = [self.normalise(text) for text in texts]
        units = [self.units.findall(p) for p, _ in plain]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        missing = set().union(*units) - self.known.keys()
        learnt = self._learn(list(missing))
        rare = {unit: learnt.pop(unit) for unit in missing if len(unit) > LONGEST_CACHED}
        self.known.update(learnt)
        known = self.known
        out, bounds = [], np.array([self.begin, self.end], "<u4")
        for own, (_, source) in zip(units, plain, strict=True):
            found = [known[u] if u in known else rare[u] for u in own] if rare else list(map(known.__getitem__, own))
            ids = np.frombuffer(b"".join([e[0] for e in found]), "<u4")
            covers = np.frombuffer(b"".join([e[1] for e in found]), "<u4")
            ends = np.cumsum(covers, dtype=np.int64)
            starts, last = source[ends - covers], source[-1:]
            out.append((
                np.concatenate([bounds[:1], ids, bounds[1:]]), np.concatenate([[0], starts, last]), np.concatenate([[0], source[ends], last]),
            ))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One model for all tasks of a worker process."""
    with open(path, "rb") as file:
        return Pieces(file.read())


def _slices(texts: list):
    """Numbers of neighbouring texts of about a megabyte together."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size > TEXT_SLICE:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _mapped(docs: DataFrame, path: str, ddl: str, kinds: list[pa.DataType], row) -> DataFrame:
    """One row for every document from its ids, spans and decoded text."""

    def work(batches):
        model = pieces_of(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last in _slices(texts):
                coded = model.encode([text or "" for text in texts[first:last]])
                back = model.decode([ids.tolist() for ids, _, _ in coded])
                columns = zip(*(row(*code, text) for code, text in zip(coded, back, strict=True)), strict=True)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(first, last - first), *arrays], names=["doc_id", *(c.split()[0] for c in ddl.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, {ddl}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends and decoded text of every row.

    ids are the model's with begin and end; starts and ends are the bytes of the original text that each piece stands for: a
    dummy space stands for none, a replaced character for all that its key replaced, and of the bytes of a character that is
    no piece the last one covers it. Whole texts are encoded, in one map without a shuffle. A null text is empty: begin and
    end alone. Repeated rows and null ids are rows like others, an empty table stays empty, other columns are ignored.
    """
    whole = pa.list_(pa.int64())

    def row(ids, starts, ends, text):
        return ids.tolist(), starts.tolist(), ends.tolist(), text

    return _mapped(docs, path or model_path(), "ids array<long>, starts array<long>, ends array<long>, decoded string", [whole, whole, whole, pa.string()], row)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same as numbers and digests, made where the ids are; spans are hashed as start and end of every piece in turn."""

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def row(ids, starts, ends, text):
        return len(ids), sha(ids.tobytes()), sha(text.encode()), sha(np.column_stack([starts, ends]).astype("<u4").tobytes())

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return _mapped(docs, path or model_path(), ddl, [pa.int64(), pa.string(), pa.string(), pa.string()], row)
