"""Texts that went through a wrong decoding: finding them and restoring what the author wrote.

A wrong decoding is a chain of steps; each took the bytes of the text in one encoding for those of another. Undoing a
step encodes in the wrong one and decodes in the right one. Candidates are made word by word, because a text may be
garbled in part: a word that holds letter pairs foreign to the labelled texts is decoded by every step whose result
lies in their alphabets, again and again while that makes it likelier in a code of letter pairs. The chains
so proposed for a text compete by description length: the whole text is compressed as it is and as each chain leaves it,
with zstandard, by the dictionary of the language that describes it best, and the cost of the chain is added. Every
chain proposed competes, alone and with the others. The shortest description wins; what no chain shortens stays
unchanged. zstandard counts in whole bytes: only where two descriptions have the same number of them, which happens to
few words in a text, the letter-pair code decides between them.

Texts are also garbled, without being recoverable, where replacement characters, C1 controls or bytes of a sequence cut
short are left over.

The model (dictionaries, alphabets, letter pairs) is made of the counts of all language-labelled texts, read whole. In
each language, letters, letter pairs and words that are fewer than one in ``RARE`` of its own are taken for noise, so
that a few garbled texts among many do not make their garble known; for the same reason the model does not grow.
zstandard trains a language's dictionary on its words in the proportions counted.

Defined results: null, empty and blank texts are not garbled and stay as they are; every row gives one row, repeated
rows too; texts are read whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalikes import plain_form
from quire.plans.session import written

#: What is fewer than one in so many of a language's letters, letter pairs or words is no part of the model.
RARE = 400_000
#: Size of a language's dictionary, and words of the text that it is trained on and of each part of that text.
DICTIONARY_BYTES, DICTIONARY_WORDS, PART_WORDS = 32_000, RARE // 2, 150
#: Characters after which a task passes on its counts.
FLUSH_CHARS = 1 << 25
#: Words remembered between texts; speed depends on it, results do not.
MEMO_WORDS = 200_000
#: Bits of description: of naming a chain, of each step, and of a letter outside the known alphabets.
CHAIN_BITS, STEP_BITS, FOREIGN_BITS = 3, 3, 20.0
#: Least gain in bits by which a word proposes a chain.
WORD_GAIN = 6.0
#: Least gain of a step by another encoding after one by UTF-8.
LATER_GAIN = 20.0

#: Encodings in which a text may have been wrongly read, and those in which it may have been written.
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "cp1253", "iso8859_2", "cp1254", "cp1257")
WRITTEN_SINGLE = ("cp1252", "cp1251", "koi8_r", "cp866", "cp1253", "mac_roman", "cp437", "cp850", "mac_cyrillic", "iso8859_5", "cp1250", "mac_greek", "cp737")
WRITTEN_MULTI = ("cp932", "euc_jp", "gb18030", "big5", "euc_kr")
READ_AS_MULTI = ("gb18030", "cp932", "big5", "euc_kr")

_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_DIGIT = re.compile("[0-9]")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_CUT = re.compile("â€|ï¿½|Ã[¢-ª¬-ºƒ€†‡ˆ‰Š‹ŒŽ•˜™š›œžŸ]")
_SPLIT, _PARTS = re.compile("[ \n\r\t]+"), re.compile("([ \n\r\t]+)")
#: Pieces of what is long between two spaces: in scripts without them, a few Han signs with the kana that follow, or kana.
_PIECES = re.compile("[㐀-鿿豈-\ufaff\U00020000-\U0003ffff]{1,4}[぀-ゟ]{0,4}|[぀-ゟ]{1,8}|[゠-ヿ]{1,12}|[^぀-ヿ㐀-鿿豈-\ufaff\U00020000-\U0003ffff]{1,32}")
#: Characters that stand for nothing visible or for a space: no evidence of garbling by themselves.
_UNSEEN = {*map(chr, (0xA0, 0xAD, 0x180E, 0x3000, 0xFEFF, 0x1680, 0x34F, 0x61C)), *map(chr, range(0x2000, 0x2010)), *map(chr, range(0x2028, 0x2030)), *map(chr, range(0x205F, 0x2070)), *map(chr, range(0x300, 0x370))}


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte, of the upper half; bytes without a character stand for the control of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    taken = set(out.values())
    for b in range(0x80, 0xA0):
        if codec == "cp1252" or b not in taken:
            out.setdefault(chr(b), b)
    return out


class _ToLatin(dict):
    """str.translate table: characters of a codec to the Latin-1 characters of their bytes, others to no byte."""

    def __init__(self, codec: str) -> None:
        super().__init__({ord(c): chr(b) for c, b in _bytes_of(codec).items()})

    def __missing__(self, code: int) -> str:
        return chr(code) if code < 0x80 else "￿"


def _tally(words: dict[str, Counter]) -> Iterator[tuple[str, str, str, int]]:
    """(language, kind, item, count) of the letters, letter pairs and words, once a task, of words counted by language."""
    for lang, own in words.items():
        found: dict[str, Counter] = {"letter": Counter(), "pair": Counter(), "word": Counter()}
        for word, n in own.items():
            w = f" {_digits(word)} "
            for kind, items in (("letter", word), ("pair", map("".join, zip(w, w[1:], strict=False))), ("word", _PIECES.findall(word) if len(word) > 12 else (word,))):
                counts = found[kind]
                for item in items:
                    counts[item] += n
        for kind, counts in found.items():
            for item, n in counts.items():
                yield lang, kind, item, n


def _dictionary(words: Iterable[tuple[str, int]]) -> bytes:
    """Compression dictionary of a language by its words and their counts: trained on a text of DICTIONARY_WORDS words in these proportions."""
    import zstandard

    words = sorted(words, key=lambda x: (-x[1], x[0]))
    share = min(1.0, DICTIONARY_WORDS / max(1, sum(n for _, n in words)))
    # where words are not set apart by spaces, none are put in
    text = [w if "⺀" <= w[-1] <= "鿿" else f"{w} " for w, n in words for _ in range(round(n * share))]
    random.Random(1).shuffle(text)  # always the same order
    raw = ["".join(text[i : i + PART_WORDS]).encode() for i in range(0, len(text), PART_WORDS)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(raw)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    """What the labelled texts say: letters, letter pairs, and a compression dictionary of each language."""

    pairs: dict[str, int] = field(default_factory=dict)
    firsts: dict[str, int] = field(default_factory=dict)
    letters: dict[str, int] = field(default_factory=dict)
    total: int = 0
    dictionaries: dict[str, bytes] = field(default_factory=dict)

    @staticmethod
    def of(letters: dict[str, int], pairs: dict[str, int], dictionaries: dict[str, bytes]) -> Model:
        firsts: Counter = Counter()
        for p, n in pairs.items():
            firsts[p[0]] += n
        return Model(pairs, dict(firsts), letters, sum(letters.values()), dictionaries)

    @staticmethod
    def fit(texts: list[tuple[str, str]]) -> Model:
        """The model of a few (language, text) at hand; that of a table is made by fit()."""
        words: dict[str, Counter] = {}
        for lang, text in texts:
            words.setdefault(lang, Counter()).update(filter(None, _SPLIT.split(text)))
        every, totals = [*_tally(words)], Counter()
        for lang, kind, _, n in every:
            totals[lang, kind] += n
        kept = [x for x in every if x[3] * RARE >= totals[x[:2]]]
        counts: dict[str, Counter] = {"letter": Counter(), "pair": Counter()}
        for _, kind, item, n in kept:
            if kind in counts:
                counts[kind][item] += n
        dictionaries = {k: _dictionary((item, n) for lang, kind, item, n in kept if lang == k and kind == "word") for k in words}
        return Model.of(dict(counts["letter"]), dict(counts["pair"]), dictionaries)


def _digits(w: str) -> str:
    """One digit for all."""
    return _DIGIT.sub("0", w)


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "가" <= c <= "힣" or "\U00020000" <= c


class Restorer:
    """Restores texts by a model; remembers words."""

    def __init__(self, model: Model) -> None:
        import zstandard

        self.m = model
        # letters known, in either case
        model.letters = {c: 1 for k in model.letters for c in (k.lower(), k.upper()) if len(c) == 1} | model.letters
        self.known = set(model.letters)
        self.compressors = {lang: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for lang, d in model.dictionaries.items()}
        self.latin = {x: _ToLatin(x) for x in READ_AS}
        #: What the steps of a longer chain leave: characters of the encodings read in.
        self.garble = {c for x in READ_AS for c in _bytes_of(x)}
        self.single: list[tuple[str, dict[str, str], set[str]]] = []
        for x in READ_AS:
            back = _bytes_of(x)
            for y in WRITTEN_SINGLE:
                if x == y:
                    continue
                table = {}
                for c, b in back.items():
                    try:
                        d = bytes([b]).decode(y)
                    except UnicodeDecodeError:
                        continue
                    if d in self.known:
                        table[c] = d
                if any(c != d for c, d in table.items()):
                    self.single.append((f"{y}>{x}", table, set(table)))
        self.memo: dict[str, tuple[str, str] | None] = {}

    # -- likelihood

    def bits(self, w: str) -> float:
        """Cost of a word with a space on either side."""
        m, cost, before = self.m, 0.0, " "
        for c in (*_digits(w), " "):
            if c in _UNSEEN:
                continue
            n = m.pairs.get(before + c)
            if not n and c.isupper() and (before == " " or before.isupper() or not before.isalpha()):
                n = m.pairs.get((before + c).lower())  # words in capitals
                if n:
                    cost += 1 - math.log2(n / m.firsts[before.lower()])
                    before = c
                    continue
            if n:
                cost -= math.log2(n / m.firsts[before])
            elif c in self.known:
                cost += min(18.0, 3 - math.log2(m.letters[c] / m.total)) if c != " " else 6.0
            else:
                cost += FOREIGN_BITS
            before = c
        return cost

    def odd(self, w: str) -> bool:
        """Whether a word holds pairs with a non-ASCII letter that the model lacks; in wide scripts, letters it lacks."""
        before, pairs = " ", self.m.pairs
        capital = w[:1].upper()  # a name in small letters: its first pairs may be known with the capital
        named = {" " + w[:1]: " " + capital, w[:2]: capital + w[1:2]} if w[:1] > "\x7f" and len(w) > 1 and capital != w[0] else {}
        for c in (*_digits(w), " "):
            if c in _UNSEEN:
                c = " "
            if c.isupper() and before.isupper() and (before + c).lower() in pairs or before.isupper() and not c.isalpha() and before.lower() + c in pairs:
                before = c
                continue
            if (c > "\x7f" or before > "\x7f") and before + c not in pairs and named.get(before + c) not in pairs and not (_wide(c) and c in self.known and (_wide(before) or before < "\x7f" or before in self.known) or _wide(before) and c in self.known):
                return True
            before = c
        return False

    # -- steps

    def _utf8(self, w: str, x: str) -> str | None:
        as_bytes = w.translate(self.latin[x])
        if not _UTF8.search(as_bytes):
            return None
        out, last = [], 0
        for found in _UTF8.finditer(as_bytes):
            d = found.group().encode("latin-1").decode()
            if d in _UNSEEN and d not in "\xa0\xad" or d not in self.known and d not in self.garble:
                continue
            out.append(w[last : found.start()])
            out.append(d)
            last = found.end()
        return "".join(out) + w[last:] if last else None

    def _multi(self, w: str, x: str, y: str) -> str | None:
        """Runs of w that lie in x and hold upper bytes, read as y."""
        table = self.latin[x]
        out, changed = [], False
        for run in re.split(r"([⺀-鿿぀-ヿ、-】]+)", w):
            if run.isascii() or "￿" in (b := run.translate(table)):
                out.append(run)
                continue
            best = None
            for low in (0, 1):
                for high in (len(b), len(b) - 1):
                    if high - low < 2:
                        continue
                    try:
                        d = b[low:high].encode("latin-1").decode(y)
                    except (UnicodeDecodeError, UnicodeEncodeError):
                        continue
                    if sum(c > "\x7f" and c not in self.known for c in d) * 8 <= len(d):
                        best = run[:low] + d + run[high:]
                        break
                if best:
                    break
            out.append(best or run)
            changed |= best is not None
        return "".join(out) if changed else None

    def _steps(self, w: str) -> Iterator[tuple[str, str]]:
        """(step, word) of every step that w admits."""
        chars, found = {c for c in w if c > "\x7f"}, False
        for x in READ_AS:
            if (d := self._utf8(w, x)) is not None:
                yield f"utf_8>{x}", d
                found = True
        if not found and w.islower():  # lead bytes that a change of case has hidden
            for form in (w.upper(), "".join([c.upper() if c in "ãâåðñîïäçì" else c for c in w])):
                if (d := self._utf8(form, "cp1252")) is not None:
                    yield "utf_8>cp1252>lower", d.lower()
        if not found and w.isupper() and (d := self._utf8(w.lower(), "cp1252")) is not None:
            yield "utf_8>cp1252>upper", d.upper()
        if sum(c.isalpha() for c in w) + len(chars - {*"–—“”‘’…«»"}) < 2:  # a lone sign is no evidence
            return
        for name, table, keys in self.single:
            if chars <= keys:
                yield name, "".join([table.get(c, c) for c in w])
        if len(w) > 3 and any(not _wide(c) for c in chars):
            for x in READ_AS:
                for y in WRITTEN_MULTI:
                    if (d := self._multi(w, x, y)) is not None:
                        yield f"{y}>{x}", d
        if any(c not in self.known for c in chars) and any(_wide(c) for c in chars):
            for x in READ_AS_MULTI:
                try:
                    d = w.encode(x).decode("utf_8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                yield f"utf_8>{x}", d

    def propose(self, w: str) -> tuple[str, str] | None:
        """(chain, restored word) of the likeliest chain, or None. What is remembered is forgotten between texts only."""
        if w in self.memo:
            return self.memo[w]
        out = None
        if self.odd(w) and ((plain := plain_form(w)) == w or self.odd(plain)):  # else look-alike letters explain it
            chain, now, cost = [], w, self.bits(w)
            first = cost
            while True:  # every step saves bits, so the chain ends
                # encodings named first are the likelier ones; after UTF-8, other encodings must save more, as what is left may be a rare word
                options = [(self.bits(d) + k * 0.02, name, d) for k, (name, d) in enumerate(self._steps(now)) if d != now]
                best = min((x for x in options if not chain or x[1].startswith("utf_8") or x[0] <= cost - LATER_GAIN and not self.odd(x[2])), default=None)
                if best is None or best[0] >= cost - 1:
                    break
                cost, now = best[0], best[2]
                chain.append(best[1])
                if not best[1].startswith("utf_8"):
                    break
            if chain and first - cost >= WORD_GAIN:
                out = ("+".join(chain), now)
        self.memo[w] = out
        return out

    def _apply(self, w: str, chain: str, own: tuple[str, str] | None) -> str:
        """w restored by a given chain where that makes it likelier; for single bytes also a part of it. own: what w itself proposes."""
        if own is not None:
            return own[1] if own[0] == chain else w
        table = next((t for n, t, _ in self.single if n == chain), None)
        if table is None or not self.odd(w) or (plain := plain_form(w)) != w and not self.odd(plain):
            return w
        options = [w]
        for i in range(1, len(w) + 1):
            for a, b in ((w[:i], w[i:]), (w[i:], w[:i])):
                if not a.isascii() and all(c in table or c < "\x80" for c in a):
                    d = "".join([table.get(c, c) for c in a])
                    options.append(d + b if w.startswith(a) else b + d)
        return min(options, key=self.bits)

    # -- description length

    def _length(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        foreign = sum(c > "\x7f" and c not in self.known and c not in _UNSEEN for c in text)
        return min((8 * len(c.compress(raw)) for c in self.compressors.values()), default=8 * len(raw)) + FOREIGN_BITS * foreign

    def restore(self, text: str) -> tuple[str, str | None]:
        """The text of shortest description and its chain; the text itself and None where no chain is shorter."""
        words = [w for w in _SPLIT.split(text) if not w.isascii()]
        if not words:
            return text, None
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        proposed = {w: p for w in set(words) if (p := self.propose(w)) is not None}
        if not proposed:
            return text, None
        chains = [c for c, _ in Counter(proposed[w][0] for w in words if w in proposed).most_common()]
        changes = {chain: {w: d for w in set(words) if (d := self._apply(w, chain, proposed.get(w))) != w} for chain in chains}

        parts, unchanged = _PARTS.split(text), self._length(text)

        def shorter(some: list[str]) -> tuple[float, dict[str, str]]:
            """Bits saved by these chains together, and their changes; of a word that several change, the commonest one's."""
            change: dict[str, str] = {}
            for chain in reversed(some):
                change |= changes[chain]
            if not change:
                return 0.0, change
            gain = unchanged - self._length("".join([change.get(p, p) for p in parts]))
            if not gain:  # the same number of bytes
                gain = sum(self.bits(w) - self.bits(change[w]) for w in words if w in change)
            return gain - sum(CHAIN_BITS + STEP_BITS * (c.count("+") + 1) for c in some), change

        best, best_bits, best_chain = None, 0.0, None
        alone = {chain: shorter([chain]) for chain in chains}
        for chain, (bits, change) in alone.items():
            if bits > best_bits:
                best, best_bits, best_chain = change, bits, chain
        # all together; where that is no shorter, those that are worth their cost
        for some in (chains, [chain for chain in chains if alone[chain][0] > 0]):
            if len(some) > 1 and (together := shorter(some))[0] > best_bits:
                best, best_chain = together[1], "|".join(some)
                break
        if best is None:
            return text, None
        return "".join([best.get(p, p) for p in parts]), best_chain

    def lost(self, text: str) -> bool:
        """Whether something garbled beyond recovery is left."""
        return not text.isascii() and (_LOST.search(text) is not None or _CUT.search(text) is not None)


# ---- operator


_TALLY = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    chars = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [*_tally(words)]
        words.clear()
        if rows:
            yield from pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _TALLY, strict=True)], schema=_TALLY).to_batches(1 << 16)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(filter(None, _SPLIT.split(text)))
            chars += len(text)
            if chars >= FLUSH_CHARS:
                yield from flush()
                chars = 0
    yield from flush()


def _trained(of: pa.Table) -> pa.Table:
    words = zip(of.column("item").to_pylist(), of.column("n").to_pylist(), strict=True)
    return pa.table({"lang": [of.column("lang")[0].as_py()], "dictionary": [_dictionary(words)]}, schema=pa.schema([("lang", pa.string()), ("dictionary", pa.binary())]))


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """The model of all texts whose language is a two-letter code. They are counted in their tasks, and dictionaries trained in a task for each language; the driver gets letters and pairs of at least one in RARE, and dictionaries."""
    usable = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").rlike("^[a-z]{2}$") & F.col("text").isNotNull())
    counted = written(usable.mapInArrow(_tallies, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"))  # two letters: at most 676 languages
    kept = counted.join(F.broadcast(totals), ["lang", "kind"]).where(F.col("n") * RARE >= F.col("total"))
    counts: dict[str, dict[str, int]] = {"letter": {}, "pair": {}}
    for r in kept.where("kind <> 'word'").groupBy("kind", "item").agg(F.sum("n").alias("n")).collect():
        counts[r.kind][r["item"]] = r.n
    dictionaries = kept.where("kind = 'word'").select("lang", "item", "n").groupBy("lang").applyInArrow(_trained, "lang string, dictionary binary").collect()
    return Model.of(counts["letter"], counts["pair"], {r.lang: bytes(r.dictionary) for r in dictionaries})


RESTORED_SCHEMA = "table_name string, row_id bigint, text string, restored string, chain string, garbled boolean"


def _run(model: Model, only_garbled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model)
        for batch in batches:
            restored, chains, garbled = [], [], []
            for text in batch.column(2).to_pylist():
                if not text or text.isascii():
                    now, chain, bad = text, None, False
                else:
                    now, chain = r.restore(text)
                    bad = chain is not None or r.lost(text)
                restored.append(now)
                chains.append(chain)
                garbled.append(bad)
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(restored, pa.string()), pa.array(chains, pa.string()), pa.array(garbled, pa.bool_())]
            if only_garbled:
                keep = pa.array(garbled, pa.bool_())
                arrays = [a.filter(keep) for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=["table_name", "row_id", "text", "restored", "chain", "garbled"])

    return run


def restore(passages: DataFrame, model: Model, *, only_garbled: bool = False) -> DataFrame:
    """Every passage (table_name, row_id, text) with its restored text, the chain undone, and whether it is garbled. No shuffle; the model is a bounded broadcast."""
    return passages.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text").mapInArrow(_run(model, only_garbled), RESTORED_SCHEMA)
