"""Token ids and prefix token counts of a byte-pair vocabulary with word ends, equal to its library's.

The vocabulary's rules let text be cut into words, and at white space: no token spans a border. Each word (ids) or chunk without
white space (prefix counts) is worked out once per worker and kept; a text is then a gather over its parts. Texts made of Latin-1 letters, digits and signs take that path.
Any other text goes through the library (ids), or through the library's own normaliser and word splitter (prefix counts).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

# the library's word rule, written out for lower-cased Latin-1
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s0-9a-zªµº²³¹¼-¾ß-öø-ÿ]+")
_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-ÿ]")
_SPACE = re.compile("[\t\n\r ]+")
WORD_END = "</w>"
KEPT = 400_000  # chunks, and words, per generation of a worker's cache; the last two generations are kept


def is_plain(text: str) -> bool:
    return _UNSAFE.search(text) is None and "<|" not in text


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Pool:
    """Integer lists by chunk in one growing array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.bounds = np.zeros((1 << 16, 2), np.int64)
        self.values, self.used = np.zeros(1 << 20, np.int32), 0

    def add(self, chunk: str, values) -> None:
        n, number = len(values), len(self.at)
        while self.used + n > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        if number == len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.values[self.used:self.used + n] = values
        self.at[chunk] = number
        self.bounds[number] = self.used, self.used + n
        self.used += n

    def add_many(self, chunks: list[str], values: np.ndarray, ends: np.ndarray) -> None:
        """The same for distinct new chunks, whose values follow each other and end at ``ends``."""
        first, number = self.used, len(self.at)
        while first + len(values) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        while number + len(chunks) > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.values[first:first + len(values)] = values
        self.bounds[number:number + len(chunks), 1] = first + ends
        self.bounds[number:number + len(chunks), 0] = first + np.concatenate(([0], ends[:-1]))
        self.at.update(zip(chunks, range(number, number + len(chunks))))
        self.used += len(values)

    def take_over(self, chunk: str, older: "_Pool") -> bool:
        number = older.at.get(chunk)
        if number is None:
            return False
        lo, hi = older.bounds[number]
        self.add(chunk, older.values[lo:hi])
        return True

    def spans(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.bounds[np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))]
        return found[:, 0], found[:, 1]


class WordBpe:
    """One loaded vocabulary with its caches. Files are read through their library, nothing is trained."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        model = json.loads(self.library.to_str())
        vocab = model["model"]["vocab"]
        self.special = [t["content"] for t in model["added_tokens"]]
        self.special_rule = re.compile(f"({'|'.join(map(re.escape, self.special))})" if self.special else "(?!)")
        self._begun: dict[tuple[str, str], list[int]] = {}
        self.ends_word = np.zeros(max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1, bool)
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.tree: list = [{}, -1, -1]  # by byte: the next node; the token that ends here inside a word, and at its end
        for token, number in vocab.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            self.ends_word[number] = ends
            letters = token[:-len(WORD_END)] if ends else token
            if all(c in byte_of for c in letters):
                node = self.tree
                for c in letters:
                    node = node[0].setdefault(byte_of[c], [{}, -1, -1])
                node[2 if ends else 1] = number
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[a + b], (*pair, rank))
        rule = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splitter = pre_tokenizers.Split(Regex(rule), behavior="removed", invert=True)
        self._stable: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list] = {}
        self.word_counts, self.older_word_counts = {}, {}
        self.ids, self.older_ids = _Pool(), _Pool()
        self.prefixes, self.older_prefixes = _Pool(), _Pool()

    # ids -------------------------------------------------------------------------------------------------------------

    def _learn_ids(self, texts: list[list[str]]) -> None:
        if len(self.ids.at) > KEPT:
            self.older_ids, self.ids = self.ids, _Pool()
        known = self.ids.at
        new = [w for w in set().union(*texts) if w not in known and not self.ids.take_over(w, self.older_ids)]
        for a in range(0, len(new), 1000):
            some = new[a:a + 1000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1  # every word's last token carries the word end
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark word ends")
            self.ids.add_many(some, ids, ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them without added special tokens."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if is_plain(t)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        for a in range(0, len(plain), 64):
            some = plain[a:a + 64]
            words = [_WORD.findall(texts[i].lower()) for i in some]
            self._learn_ids(words)
            for i, own in zip(some, words):
                lo, hi = self.ids.spans(own)
                sizes = hi - lo
                before = np.cumsum(sizes) - sizes
                out[i] = self.ids.values[np.repeat(lo - before, sizes) + np.arange(int(sizes.sum()))]
        return out

    # counts at every prefix ------------------------------------------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stood at one end while ``token`` was built, each with the rank of the merge that absorbed it."""
        found = self._spines.get((token, side))
        if found is None:
            found, absorbed = [], len(self.rank) + 1
            while True:
                found.append((token, absorbed))
                if token not in self.parts:
                    break
                left, right, absorbed = self.parts[token]
                token = right if side else left
            self._spines[(found[0][0], side)] = found
        return found

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether the text of a followed by that of b is encoded as exactly a, b: no merge ever crosses the border."""
        known = True
        for x, x_gone in self._spine(a, 1):
            for y, y_gone in self._spine(b, 0):
                rank = self.rank.get((x, y))
                # of equal merges the left one comes first, so a tie with the right side crosses the border
                if rank is not None and rank < x_gone and rank <= y_gone:
                    known = False
        if len(self._stable) > 2_000_000:
            self._stable.clear()
        self._stable[(a << 20) | b] = known
        return known

    def word_prefixes(self, word: str) -> list[int]:
        """Token counts of word[:1], word[:2], ..., each taken as a whole word, by dynamic programming over prefixes.

        last[j] is the last token of the first j bytes without a word end. An encoding is the one sequence whose
        neighbours are all stable, so the encoding of a longer prefix is that of a shorter one and one more token.
        """
        raw = word.encode("utf-8")
        n = len(raw)
        last, count, whole = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        stable, root = self._stable, self.tree
        for i in range(n):
            before, tokens = last[i] << 20, count[i] + 1
            node = root
            for j in range(i + 1, n + 1):
                node = node[0].get(raw[j - 1])
                if node is None:
                    break
                token = node[1]
                if token >= 0 and last[j] < 0:
                    fits = True
                    if i:
                        fits = stable.get(before | token)
                        if fits is None:
                            fits = self._is_stable(last[i], token)
                    if fits:
                        last[j], count[j] = token, tokens
                token = node[2]
                if token >= 0 and not whole[j]:
                    fits = True
                    if i:
                        fits = stable.get(before | token)
                        if fits is None:
                            fits = self._is_stable(last[i], token)
                    if fits:
                        whole[j] = tokens
        if n == len(word):
            return whole[1:]
        ends, at = [], 0
        for c in word:
            at += len(c.encode("utf-8"))
            ends.append(whole[at])
        return ends

    def _pieces(self, words: list[str]) -> list[int]:
        counts, before = [], 0
        for word in words:
            if word in _CONTRACTIONS and len(word) == 3:  # "'l" is not a contraction yet
                own = [1, 1 + self._whole(word[1])[0], self._whole(word)[-1]]
            else:
                own = self._whole(word)
            counts += own if not before else [before + c for c in own]
            before += own[-1]
        return counts

    def _whole(self, word: str) -> tuple:
        found = self.word_counts.get(word)
        if found is None:
            found = self.older_word_counts.get(word) or tuple(self.word_prefixes(word))
            self.word_counts[word] = found
        return found

    def _strange(self, chunk: str) -> list[int]:
        """Prefix counts of a chunk in NFC with any characters, special strings included."""
        counts: list[int] = []
        done, head = 0, ""
        for part in self.special_rule.split(chunk):
            if part in self.special:
                begun = self._begun.get((head, part))
                if begun is None:
                    begun = [len(self.library.encode(head + part[:k], add_special_tokens=False).ids) for k in range(1, len(part))]
                    if not head:
                        self._begun[head, part] = begun
                own = counts[-1] - done if head else 0
                counts += [*(done + c for c in begun), done + own + 1]
                done, head = done + own + 1, ""
            elif part:
                counts += [done + c for c in self._between_specials(part)]
                head = part
        return counts

    def _between_specials(self, chunk: str) -> list[int]:
        lowered = [c.lower() for c in chunk]
        text = "".join(lowered)
        if self.library.normalizer.normalize_str(chunk) != text:  # another Unicode version, or white space beyond ASCII
            return [len(self.library.encode(chunk[:k], add_special_tokens=False).ids) for k in range(1, len(chunk) + 1)]
        counts = np.zeros(len(text) + 1, np.int64)
        before, done = 0, 0
        for word, (lo, hi) in self.splitter.pre_tokenize_str(text):
            counts[done:lo + 1] = before
            own = self._pieces([word])
            counts[lo + 1:hi + 1] = np.array(own) + before
            before, done = before + own[-1], hi + 1
        counts[done:] = before
        return counts[np.cumsum([len(c) for c in lowered])].tolist()

    def prefix_counts(self, text: str) -> np.ndarray:
        """For n = 1, 2, ...: how many tokens the first n characters have. Texts that are not NFC are taken in NFC."""
        plain = is_plain(text)
        if not plain:
            text = unicodedata.normalize("NFC", text)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        chunks = (text.lower() if plain else text)
        chunks = chunks.split() if plain else [c for c in _SPACE.split(chunks) if c]
        if not chunks:
            return np.zeros(len(points), np.int32)
        if len(self.prefixes.at) > KEPT:
            self.older_prefixes, self.prefixes = self.prefixes, _Pool()
        if len(self.word_counts) > KEPT:
            self.older_word_counts, self.word_counts = self.word_counts, {}
        for chunk in chunks:
            name = chunk if plain else "\n" + chunk  # the two ways must not share a key
            if name not in self.prefixes.at and not self.prefixes.take_over(name, self.older_prefixes):
                self.prefixes.add(name, self._pieces(_WORD.findall(chunk)) if plain else self._strange(chunk))
        lo, hi = self.prefixes.spans(chunks if plain else ["\n" + c for c in chunks])
        values = self.prefixes.values
        after = np.cumsum(values[hi - 1])
        filled = ~((points == 32) | (points == 9) | (points == 10) | (points == 13))
        begins = filled.copy()
        begins[1:] &= ~filled[:-1]
        starts = np.flatnonzero(begins)
        which = np.cumsum(begins)  # 1-based number of the chunk last begun
        out = np.concatenate(([0], after)).astype(np.int32)[which]
        at = np.flatnonzero(filled)
        own = which[at] - 1
        out[at] = values[at + (lo - starts)[own]] + (after - values[hi - 1])[own]
        return out


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The vocabulary at ``path``, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
