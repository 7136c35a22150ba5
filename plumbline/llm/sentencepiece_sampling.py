"""SentencePiece encoding and decoding, with distinct sampled segmentations.

Encoding gives the tokenizer's own pieces; decoding joins pieces back to the text, exactly.  Sampling draws k different
segmentations of each text without replacement: segmentations carry a Gumbel-perturbed log probability and the k
largest are the sample.  They are found by A-star search over the lattice of pieces: a queue holds sets of segmentations with the
perturbed value of their best member (an exact bound); the best set is popped, its best member is drawn, and what is
left of the set is split by the first place where it differs, each part getting a truncated Gumbel of its own mass.  The
first value not taken is the threshold of the inclusion scores ``1 - exp(-exp(log p - threshold))``.

Pieces never cross the start of a word (a run of spaces and what follows), so a text's lattice is a chain of word lattices;
what is left of a word from some character on is one state however many words of a batch end so, a worker keeps the words it has
met from batch to batch (up to ``MOST_STATES`` states), and states are normalised from the end, so a draw walks forward without a dead end.  The weights of pieces follow their rank in the vocabulary (``-POWER * log(rank + RANK_SHIFT)``).  Draws
are hashes of the row's key, so they do not depend on partitions or retries.

Whole texts, one narrow pass.  Defined cases: a null or empty text has no pieces, one segmentation (the empty one) and decodes to the
empty text; a text with fewer than k segmentations gives all of them, with inclusion score 1; repeated rows are sampled alike; a
null ``doc_id`` is the key 0; a text that itself holds the character that marks spaces does not decode to itself and is flagged; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from plumbline.llm._repeats import mix, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
POWER, RANK_SHIFT = 1.0, 2.7
SPACE = "▁"
MARK = SPACE.encode()
CHUNK_CHARS = 1 << 20
USUAL = 64  # characters with a table of steps
MOST_STATES = 1_000_000  # lattice states a worker keeps from batch to batch
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def trie_of(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix tree of the pieces as sorted arrays: characters, steps (node by character), nodes reached, piece of each node."""
    characters = np.unique(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32))
    number = {chr(c): i for i, c in enumerate(characters.tolist())}
    steps: dict[int, int] = {}
    ends = [-1]
    for piece, own in pieces.items():
        node = 0
        for c in piece:
            key = node * len(characters) + number[c]
            node = steps.setdefault(key, len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = own
    keys = np.array(sorted(steps), np.int64)
    return characters, keys, np.array([steps[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)


class Vocabulary:
    """A tokenizer's pieces, their weights and spelling; one per worker process."""

    def __init__(self, model: bytes):
        self.tool = tool = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = tool.get_piece_size()
        pieces = {tool.id_to_piece(i): i for i in range(size)
                  if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))}
        bytewise = {i: bytes([int(tool.id_to_piece(i)[3:5], 16)]) for i in range(size) if tool.is_byte(i)}
        self.mark = pieces.get(SPACE, tool.unk_id())
        self.of_byte = np.full(256, tool.unk_id(), np.int64)
        for i, b in bytewise.items():
            self.of_byte[b[0]] = i
        self.weight = -POWER * np.log(np.arange(size) + RANK_SHIFT)
        self.characters, self.steps, self.nodes, self.ends = trie_of(pieces)
        # Steps by the characters that most steps have are in a table, a row a node; the others are searched for.
        by, of = self.steps % len(self.characters), self.steps // len(self.characters)
        usual = np.argsort(-np.bincount(by, minlength=len(self.characters)), kind="stable")[:USUAL]
        self.column = np.full(len(self.characters) + 1, -1, np.int32)  # the last is for characters in no piece
        self.column[usual] = np.arange(len(usual))
        self.table = np.full(len(self.ends) * USUAL, -1, np.int32)
        on = self.column[by] >= 0
        self.table[of[on] * USUAL + self.column[by[on]]] = self.nodes[on]
        spelling = [b""] * size
        for i, b in bytewise.items():
            spelling[i] = b
        for p, i in pieces.items():
            spelling[i] = p.encode()
        self.letters = np.frombuffer(b"".join(spelling), np.uint8)
        self.length = np.array([len(b) for b in spelling], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Nodes reached from nodes by characters, -1 for none."""
        column = self.column[number]
        reached = self.table[node * USUAL + column]  # a row of the table ends before the next: -1 reads some other node's, set right below
        rare = np.flatnonzero(column < 0)
        key = node[rare] * len(self.characters) + number[rare]
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        reached[rare] = np.where((self.steps[at] == key) & (number[rare] >= 0), self.nodes[at], -1)
        return reached

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the pieces in turn, marks in place of spaces."""
        return self.letters[spread(self.begin[ids], self.length[ids])]

    def spells(self, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the pieces of each text (``counts`` of ``ids``, one at least) spell it."""
        made = self.decode_bytes(ids).tobytes()
        ends = np.cumsum(np.add.reduceat(self.length[ids], np.cumsum(counts) - counts))
        cuts = itertools.pairwise([0, *ends.tolist()])
        return np.array([made[a:b] == text for (a, b), text in zip(cuts, texts, strict=True)], bool)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace").replace(SPACE, " ")[1:]


class Lattices:
    """The lattices of different words, in flat arrays that grow as words are added.

    A state is what is left of a word from some character on; words that end alike share the states of what they share.  State s
    has the character ``number[s]``, is followed by the state ``rest[s]`` (-1 at the word's end) and has the edges ``first[s] : first[s + 1]``;
    ``running`` is the running chance of a state's edges, ``log`` the logarithm of an edge's chance, ``others`` the chance of the state's other edges.
    A character without a piece has an edge that spells it in bytes (``spelt`` of the edge, else -1).
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str] | None = None):
        self.vocabulary = vocabulary
        self.spellings: list[np.ndarray] = []
        self.held: dict[str, np.ndarray] = {}
        none, real = np.zeros(0, np.int32), np.zeros(0)
        self.grow(start=np.zeros(0, np.int64), first=np.zeros(1, np.int64), number=np.zeros(0, np.int64), rest=none, mass=real,
                  piece=none, next_state=none, chance=real, log=real, running=real, others=real)
        self.add(words or [])

    def grow(self, **columns: np.ndarray) -> None:
        """Appends to arrays, which have room for more."""
        for name, values in columns.items():
            have = len(getattr(self, name, ()))
            room = self.held.get(name)
            if room is None or have + len(values) > len(room):
                room = np.empty(max(2 * have, have + len(values), 1024), values.dtype)
                room[:have] = getattr(self, name, ())
                self.held[name] = room
            room[have:have + len(values)] = values
            setattr(self, name, room[:have + len(values)])

    def add(self, words: list[str]) -> None:
        """Appends words, which get the next numbers.  States are shared among the words of a call."""
        if not words:
            return
        old = len(self.rest)
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        turn = np.argsort(left.astype(np.uint16) if int(sizes.max()) < 1 << 16 else left, kind="stable")
        levels = np.split(turn, np.flatnonzero(np.diff(left[turn])) + 1)
        # Ends of one character, then of two, and so on: a state is a character and the state that follows.
        state, made, ends = np.full(len(text) + 1, -1, np.int64), [], [0]
        for level in levels:
            ahead = state[level + 1] if len(made) else np.full(len(level), -1, np.int64)
            coded = pa.array(((ahead + 1) << 21) | text[level]).dictionary_encode()
            made.append(coded.dictionary.to_numpy())
            state[level] = coded.indices.to_numpy() + ends[-1]
            ends.append(ends[-1] + len(made[-1]))
        key = np.concatenate(made)
        rest = (key >> 21) - 1
        self.grow(start=old + state[np.cumsum(sizes) - sizes])
        self.link(old, key & ((1 << 21) - 1), np.where(rest >= 0, rest + old, -1).astype(np.int32), ends)

    def link(self, old: int, letters: np.ndarray, rest: np.ndarray, ends: list[int]) -> None:
        """Edges and chances of the states from ``old`` on, given their characters, next states and where each length ends."""
        vocabulary = self.vocabulary
        n = len(letters)
        place = np.minimum(np.searchsorted(vocabulary.characters, letters), len(vocabulary.characters) - 1)
        self.grow(number=np.where(vocabulary.characters[place] == letters, place, -1), rest=rest, mass=np.zeros(n))
        # All pieces that start at each state, by walking the prefix tree from all of them at once.
        at, node = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
        ahead = at + np.int32(old)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros(n, np.int32)
        while len(at):
            node = vocabulary.step(node, self.number[ahead])
            on = np.flatnonzero(node >= 0)
            at, ahead, node = at[on], self.rest[ahead[on]], node[on]
            piece = vocabulary.ends[node]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], piece[whole], ahead[whole]))
            counts[found[-1][0]] += 1
            going = np.flatnonzero(ahead >= 0)
            at, ahead, node = at[going], ahead[going], node[going].astype(np.int64)
        bare = np.ones(n, bool)
        bare[found[0][0]] = False
        bare = np.flatnonzero(bare).astype(np.int32)
        odd_pieces = -1 - len(self.spellings) - np.arange(len(bare))
        self.spellings += [vocabulary.of_byte[np.frombuffer(chr(c).encode(errors="replace"), np.uint8)] for c in letters[bare].tolist()]
        counts[bare] += 1
        found.insert(0, (bare, odd_pieces, rest[bare]))
        # A state has one piece of a length at most: each length fills the next free place of its states.
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        free, total = first[:-1].copy(), int(first[-1])
        pieces, target = np.empty(total, np.int32), np.empty(total, np.int32)
        for at, piece, ahead in found:
            slot = free[at]
            pieces[slot], target[slot] = piece, ahead
            free[at] += 1
        weight = vocabulary.weight[np.maximum(pieces, 0)]
        odd = np.flatnonzero(pieces < 0)
        weight[odd] = [float(vocabulary.weight[self.spellings[-1 - p]].sum()) for p in pieces[odd].tolist()]
        # Log mass from each state to its word's end: states one character from the end first, then two, and so on.
        mass = self.mass
        for a, b in itertools.pairwise(ends):
            edges, begin = slice(first[a], first[b]), first[a:b] - first[a]
            values = weight[edges] + np.where(target[edges] >= 0, mass[target[edges]], 0.0)
            top = np.maximum.reduceat(values, begin)
            mass[old + a:old + b] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, counts[a:b])), begin))
        chance = np.exp(weight + np.where(target >= 0, mass[target], 0.0) - np.repeat(mass[old:], counts))
        begin = first[:-1]
        chance = chance / np.repeat(np.add.reduceat(chance, begin), counts)
        inside = np.cumsum(chance)
        running = inside - np.repeat((inside - chance)[begin], counts)
        running[first[1:] - 1] = 1.0
        # What a state has beside an edge of more than half is summed without that edge, so that little is not lost.
        large = chance > 0.5
        beside = np.add.reduceat(np.where(large, 0.0, chance), begin)
        others = np.where(large, np.repeat(beside, counts), 1.0 - chance)
        self.grow(first=first[1:] + len(self.piece))
        self.grow(piece=pieces, next_state=target, chance=chance, log=np.log(chance), running=running, others=others)

    def walk(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a drawn path from each state to its word's end, in order, and how many each has."""
        place, steps, n, turn = np.arange(len(states)), [], len(states), 0
        while len(states):
            edge, drawn = self.first[states], uniform(keys, turn)
            beyond = np.flatnonzero(drawn >= self.running[edge])
            while len(beyond):  # the last edge of a state runs to 1, which no draw reaches
                edge[beyond] += 1
                beyond = beyond[drawn[beyond] >= self.running[edge[beyond]]]
            steps.append((place, edge))
            ahead = self.next_state[edge]
            going = ahead >= 0
            place, states, keys, turn = place[going], ahead[going], keys[going], turn + 1
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = np.bincount(np.concatenate([p for p, _ in steps]), minlength=n)
        begin, edges = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
        for turn, (place, edge) in enumerate(steps):
            edges[begin[place] + turn] = edge
        return edges, counts

    def spell(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths, and how many each edge has."""
        piece, counts = self.piece[edges].astype(np.int64), np.ones(len(edges), np.int64)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece, counts
        spelt = [self.spellings[-1 - p] for p in piece[odd].tolist()]
        counts[odd] = [len(s) for s in spelt]
        ids = np.repeat(piece, counts)
        ids[np.repeat(piece < 0, counts)] = np.concatenate(spelt)
        return ids, counts

    def left_over(self, state: int, taken: list[tuple[int, ...]]) -> float:
        """Chance of the paths from ``state`` other than those taken."""
        total, open_sets = 0.0, [(state, taken, 1.0)]
        while open_sets:
            at, paths, reach = open_sets.pop()
            while at >= 0 and paths:
                ahead: dict[int, list[tuple[int, ...]]] = {}
                for path in paths:
                    ahead.setdefault(path[0], []).append(path[1:])
                for edge in range(self.first[at], self.first[at + 1]):
                    if edge not in ahead:
                        total += reach * float(self.chance[edge])
                (edge, paths), *others = ahead.items()
                open_sets += [(int(self.next_state[e]), p, reach * float(self.chance[e])) for e, p in others]
                reach *= float(self.chance[edge])
                at = int(self.next_state[edge])
        return total

    def turn_off(self, state: int, taken: list[tuple[int, ...]], key: int) -> tuple[list[int], int]:
        """Where a drawn path from ``state`` that is none of those taken has left them all: its edges so far and the state reached."""
        path: list[int] = []
        turn = 0
        while state >= 0 and taken:
            options = list(range(self.first[state], self.first[state + 1]))
            masses = []
            for edge in options:
                rest = [t[1:] for t in taken if t[0] == edge]
                masses.append(float(self.chance[edge]) * (self.left_over(int(self.next_state[edge]), rest) if rest else 1.0))
            at = uniform_of(key, turn) * sum(masses)
            turn += 1
            for edge, mass in zip(options, masses, strict=True):
                if mass > 0:
                    chosen, at = edge, at - mass
                    if at < 0:
                        break
            path.append(chosen)
            taken = [t[1:] for t in taken if t[0] == chosen]
            state = int(self.next_state[chosen])
        return path, state


def hashed(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    return mix(mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt + 1).astype(np.uint64)) ^ keys)


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1), one a key and turn."""
    return ((hashed(keys, turn) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def uniform_of(key: int, turn: int) -> float:
    """As ``uniform``, of one key."""
    def mixed(x: int) -> int:
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & (2**64 - 1)
        return x ^ (x >> 29)

    return ((mixed(mixed((key + 0x9E3779B97F4A7C15 * (turn + 1)) & (2**64 - 1)) ^ key) >> 11) + 0.5) / 2.0**53


def truncated(mass: np.ndarray, below: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Gumbels of the given log masses, given that they lie below a value."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.logaddexp(mass - below, np.log(-np.log(drawn))))


class Round:
    """One segmentation of each text still sampled: paths of all words in order, and what is left of its set.

    ``texts`` names the texts, ``words`` and ``begin`` their words.  ``values`` has, at a word, the perturbed value of
    the segmentations of the set that differ from this one first at that word.
    """

    def __init__(self, of: Lattices, texts: np.ndarray, counts: np.ndarray, edges: np.ndarray, path: np.ndarray, value: np.ndarray,
                 keys: np.ndarray, salt: int, place: np.ndarray, left: np.ndarray):
        self.texts, self.counts, self.edges, self.path, self.value, self.place = texts, counts, edges, path, value, place
        self.begin = np.cumsum(counts) - counts  # first word of each text
        self.path_begin = np.cumsum(path) - path  # first edge of each word
        self.row = np.full(int(texts.max()) + 1, -1)
        self.row[texts] = np.arange(len(texts))
        logs = of.log[edges]
        before = np.cumsum(logs) - logs
        reach = np.exp(before - np.repeat(before[self.path_begin], path))
        miss = np.add.reduceat(reach * of.others[edges], self.path_begin)
        log = np.add.reduceat(logs, self.path_begin)
        prior = np.cumsum(log) - log
        prior -= np.repeat(prior[self.begin], counts)
        self.log = np.add.reduceat(log, self.begin)
        word = np.arange(len(path)) - np.repeat(self.begin, counts)
        with np.errstate(divide="ignore"):
            mass = prior + np.log(miss)
            again = place >= 0  # the word where the set began has several paths taken
            mass[(self.begin + place)[again]] = prior[(self.begin + place)[again]] + np.log(left[again])
        mass[word < np.repeat(place, counts)] = -np.inf
        self.values = truncated(mass, np.repeat(value, counts), uniform(hashed(np.repeat(keys, counts), word), 1000 + salt))
        self.taken: dict[int, list[tuple[int, ...]]] = {}  # by text, of the word where its set began

    def word_path(self, text: int, word: int) -> tuple[int, ...]:
        at = self.begin[self.row[text]] + word
        return tuple(self.edges[self.path_begin[at]:self.path_begin[at] + self.path[at]].tolist())

    def best(self) -> np.ndarray:
        return np.maximum.reduceat(self.values, self.begin)


def sample(of: Lattices, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Round], np.ndarray]:
    """Up to k different segmentations of each text, best first, and the first perturbed value not taken.

    ``words`` has the words of all texts in turn, ``counts`` how many each has (one at least), ``keys`` the texts' keys.
    """
    n = len(counts)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    states = of.start[words]
    begin = np.cumsum(counts) - counts
    value = -np.log(-np.log(uniform(keys, 0)))
    edges, path = of.walk(states, hashed(np.repeat(keys, counts), inside))
    rounds = [Round(of, np.arange(n), counts, edges, path, value, keys, 0, np.full(n, -1), np.zeros(n))]
    # The queue of each text: the best value left in each round.
    best = np.full((k + 1, n), -np.inf)
    best[0] = rounds[0].best()
    for r in range(1, k):
        texts = np.flatnonzero(best.max(axis=0) > -np.inf)
        if not len(texts):
            break
        source = best[:, texts].argmax(axis=0)
        value = best[source, texts]
        place, left, parts, lengths, taken_of = [], [], [], [], {}
        turned, late_states, late_counts = [], [], []
        own_keys = hashed(keys[texts], 7_000 + r)
        for text, number, key in zip(texts.tolist(), source.tolist(), own_keys.tolist(), strict=True):
            old = rounds[number]
            row = old.row[text]
            a, b = int(old.begin[row]), int(old.begin[row] + old.counts[row])
            at = int(old.values[a:b].argmax())
            old.values[a + at] = -np.inf
            best[number, text] = old.values[a:b].max()
            # The word where the old set itself began has more paths taken than the old segmentation's.
            taken = list(old.taken[text]) if at == old.place[row] else [old.word_path(text, at)]
            state = int(states[begin[text] + at])
            turned.append((state, taken, *of.turn_off(state, taken, key)))
            place.append(at)
            first = old.path_begin[a]
            parts.append(old.edges[first:old.path_begin[a + at]])
            lengths.append(old.path[a:a + at])
            late_counts.append(b - a - at - 1)
            late_states.append(states[begin[text] + at + 1:begin[text] + counts[text]])
        # The ends of the words where the new paths turn off, then all words behind them.
        reached = np.array([t[3] for t in turned], np.int64)
        ended, steps = of.walk(reached[reached >= 0], hashed(own_keys[reached >= 0], 99))
        many = np.zeros(len(texts), np.int64)
        many[reached >= 0] = steps
        news = []
        for text, (state, taken, path, _), a, n_edges in zip(texts.tolist(), turned, (np.cumsum(many) - many).tolist(), many.tolist(), strict=True):
            news.append(path + ended[a:a + n_edges].tolist())
            taken_of[text] = [*taken, tuple(news[-1])]
            left.append(of.left_over(state, taken_of[text]))
        behind = np.array(late_counts, np.int64)
        late_keys = hashed(np.repeat(own_keys, behind), spread(np.array(place, np.int64) + 1, behind))
        late_edges, late_path = of.walk(np.concatenate(late_states), late_keys)
        word_at, edge_at, edges, path = 0, 0, [], []
        late_ends = np.concatenate(([0], np.cumsum(late_path)))
        for prefix, new, length, count in zip(parts, news, lengths, late_counts, strict=True):
            stop = int(late_ends[word_at + count])
            edges += [prefix, np.array(new, np.int64), late_edges[edge_at:stop]]
            path += [length, [len(new)], late_path[word_at:word_at + count]]
            word_at, edge_at = word_at + count, stop
        made = Round(of, texts, counts[texts], np.concatenate(edges).astype(np.int64), np.concatenate(path).astype(np.int64), value,
                     keys[texts], r, np.array(place), np.array(left))
        made.taken = taken_of
        rounds.append(made)
        best[r, texts] = made.best()
    return rounds, best.max(axis=0)


def words_of(text: str) -> list[str]:
    """The text as the tokenizer sees it: marks for spaces, one in front, cut in front of each run of marks."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lexicon:
    """The words that a worker has met, numbered, with the tokenizer's own pieces and their lattices."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.lattices = vocabulary, Lattices(vocabulary)
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.pieces, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, which have spaces for marks; new ones are added."""
        old, coded = len(self.number), words.dictionary_encode()
        found = np.fromiter(map(self.number.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        if len(self.number) > old:
            fresh = [w.replace(" ", SPACE) for w in itertools.islice(self.number, old, None)]
            pieces, sizes = encode_words(self.vocabulary, fresh)
            self.pieces, self.sizes = np.concatenate([self.pieces, pieces]), np.concatenate([self.sizes, sizes])
            self.lattices.add(fresh)
        return found[coded.indices.to_numpy()]

    def encoded(self, words: np.ndarray) -> np.ndarray:
        """The tokenizer's pieces of words in turn."""
        first = np.cumsum(self.sizes) - self.sizes
        return self.pieces[spread(first[words], self.sizes[words])]


_lexicons: dict[bytes, Lexicon] = {}


def lexicon_of(vocabulary: Vocabulary, key: bytes) -> Lexicon:
    """One per worker process; begun anew when it holds ``MOST_STATES``."""
    held = _lexicons.get(key)
    if held is None or held.vocabulary is not vocabulary or len(held.lattices.rest) > MOST_STATES:
        _lexicons.clear()
        held = _lexicons[key] = Lexicon(vocabulary)
    return held


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """What ``words_of`` cuts the marked texts into, with spaces for marks, and how many words each text has."""
    plain = [t.replace(MARK, b" ") for t in texts]
    sizes = np.array([len(t) for t in plain], np.int64)
    joined = b"".join(plain)
    space = np.frombuffer(joined, np.uint8) == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    starts[begin] = True  # each text that is not empty has a mark in front
    at = np.flatnonzero(starts)
    cuts = np.append(at, len(joined)).astype(np.int32)
    counts = np.zeros(len(texts), np.int64)
    counts[sizes > 0] = np.diff(np.append(np.searchsorted(at, begin), len(at)))
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(joined)), counts


_vocabularies: dict[bytes, Vocabulary] = {}


def vocabulary_of(model: bytes) -> Vocabulary:
    """One per worker process and model."""
    key = hashlib.sha256(model).digest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def row_keys(ids: list[int | None]) -> np.ndarray:
    return mix(np.array([(i or 0) & (2**64 - 1) for i in ids], np.uint64) + np.uint64(0x5851F42D4C957F2D))


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's own pieces of each word, and how many."""
    lists = vocabulary.tool.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
    lists = [[vocabulary.mark] if w == SPACE else p for w, p in zip(words, lists, strict=True)]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum())), counts


SCHEMA = {
    "doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "decodes": pa.bool_(), "samples": pa.list_(pa.list_(pa.int32())),
    "log_chances": pa.list_(pa.float64()), "inclusions": pa.list_(pa.float64()),
}
DIGESTS = {"n_ids": pa.int32(), "ids_sha256": pa.string(), "n_sampled": pa.int32(), "sample_sizes": pa.list_(pa.int32()), "samples_sha256": pa.string()}


def encode_and_sample(docs: DataFrame, model_path: str = MODEL, k: int = SAMPLES, digests: bool = False,
                      carry: list[str] | None = None) -> DataFrame:
    """``doc_id, ids, decodes, samples, log_chances, inclusions`` of every row; with ``digests`` numbers and digests of the
    id lists follow."""
    along = carry or []
    with open(model_path, "rb") as file:  # on the driver; tasks get the bytes
        model = file.read()
    digest = hashlib.sha256(model).digest()
    names = SCHEMA | (DIGESTS if digests else {})

    def rows(ids: list, texts: list[str], own: Vocabulary) -> list[pa.Array]:
        n, lexicon = len(ids), lexicon_of(own, digest)
        spaced = [MARK + text.encode().replace(b" ", MARK) if text else b"" for text in texts]
        split, counts = split_words(spaced)
        words = lexicon.numbers(split)
        some = np.flatnonzero(counts)
        marked = [spaced[i] for i in some.tolist()]
        decodes = np.array([SPACE not in text for text in texts], bool)
        sizes, threshold = np.zeros(n, np.int64), np.full(n, -np.inf)
        encoded = lexicon.encoded(words).astype(np.int32)
        # Samples of texts without words: one, of no pieces.
        blank = np.flatnonzero(counts == 0)
        parts = [(blank, np.zeros(0, np.int64), np.zeros(len(blank), np.int64), np.zeros(len(blank)))]
        if len(some):
            begin = np.cumsum(counts[some]) - counts[some]
            sizes[some] = np.add.reduceat(lexicon.sizes[words], begin)
            decodes[some] &= own.spells(encoded, sizes[some], marked)
            rounds, threshold[some] = sample(lexicon.lattices, words, counts[some], row_keys([ids[i] for i in some.tolist()]), k)
            for r in rounds:
                spelt, many = lexicon.lattices.spell(r.edges)
                per_text = np.add.reduceat(np.add.reduceat(many, r.path_begin), r.begin)
                parts.append((some[r.texts], spelt, per_text, r.log))
                decodes[some[r.texts]] &= own.spells(spelt, per_text, [marked[t] for t in r.texts.tolist()])
        # Samples by text, best first.
        of = np.concatenate([p[0] for p in parts])
        order = np.argsort(of, kind="stable")
        lengths, logs = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])[order]
        flat = np.concatenate([p[1] for p in parts])[spread((np.cumsum(lengths) - lengths)[order], lengths[order])].astype(np.int32)
        of, lengths = of[order], lengths[order]
        sampled = np.bincount(of, minlength=n)
        with np.errstate(over="ignore"):
            inclusions = -np.expm1(-np.exp(np.minimum(logs - threshold[of], 700.0)))

        def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), values)

        columns = [pa.array(ids, pa.int64()), lists(sizes, pa.array(encoded)), pa.array(decodes), lists(sampled, lists(lengths, pa.array(flat))),
                   lists(sampled, pa.array(logs)), lists(sampled, pa.array(inclusions))]
        if digests:
            cuts = itertools.pairwise(offsets(sizes).tolist())
            whole = [hashlib.sha256(encoded[a:b].tobytes()).hexdigest() for a, b in cuts]
            each = [flat[a:b].tobytes() + b"|" for a, b in itertools.pairwise(offsets(lengths).tolist())]
            joined = [hashlib.sha256(b"".join(each[a:b])).hexdigest() for a, b in itertools.pairwise(offsets(sampled).tolist())]
            columns += [pa.array(sizes, pa.int32()), pa.array(whole), pa.array(sampled, pa.int32()), lists(sampled, pa.array(lengths, pa.int32())), pa.array(joined)]
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary_of(model)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            start = held = 0
            for i, text in enumerate([*texts, None]):
                if i > start and (text is None or held + len(text) > CHUNK_CHARS):
                    columns = rows(ids[start:i], texts[start:i], own) + [batch[c].slice(start, i - start) for c in along]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *along])
                    start, held = i, 0
                held += len(text or "")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *along)
    result = [*from_arrow_schema(pa.schema(list(names.items()))).fields, *plain.select(*along).schema.fields]
    return plain.mapInArrow(run, T.StructType(result))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
