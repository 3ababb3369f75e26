"""A Git repository as tables, read from its object files without a Git program.

Objects are loose (zlib) or in packs (index version 2, with offset and reference deltas). The walk over
commits is sequential and holds ids only; what each commit changed and who wrote each line is found
in tasks, which open the repository by its path, so it has to be in a folder that all executors see."""

from __future__ import annotations

import difflib
import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
COMMITS = "hash string, parents array<string>, author string, email string, ts timestamp, message string"
CHANGES = "hash string, author string, ts timestamp, file string, change string, insertions long, deletions long"
BLAME = "file string, line long, author string, hash string, ts timestamp"


@dataclass(frozen=True)
class Commit:
    hash: str
    tree: str
    parents: tuple[str, ...]
    author: str
    email: str
    time: int
    message: str


class Pack:
    """One pack and its index."""

    def __init__(self, path: str):
        self.path = path
        with open(path[:-5] + ".idx", "rb") as f:
            self.index = f.read()
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: only pack indexes of version 2 are read")
        self.fan = struct.unpack(">256I", self.index[8 : 8 + 1024])
        self.count = self.fan[255]
        with open(path, "rb") as f:
            self.data = f.read()

    def offset(self, name: bytes) -> int | None:
        low, high = (self.fan[name[0] - 1] if name[0] else 0), self.fan[name[0]]
        names = 8 + 1024
        while low < high:
            mid = (low + high) // 2
            at = self.index[names + 20 * mid : names + 20 * mid + 20]
            if at == name:
                offsets = names + 24 * self.count
                place = struct.unpack(">I", self.index[offsets + 4 * mid : offsets + 4 * mid + 4])[0]
                if place >> 31:
                    big = offsets + 4 * self.count + 8 * (place & 0x7FFFFFFF)
                    place = struct.unpack(">Q", self.index[big : big + 8])[0]
                return place
            low, high = (mid + 1, high) if at < name else (low, mid)
        return None

    def read(self, offset: int, repo: Repo) -> tuple[str, bytes]:
        deltas, data = [], self.data
        while True:
            at, start = offset, offset
            byte = data[at]
            kind, at = (byte >> 4) & 7, at + 1
            while byte & 0x80:
                byte = data[at]
                at += 1
            if kind == 6:
                byte = data[at]
                at += 1
                back = byte & 0x7F
                while byte & 0x80:
                    byte = data[at]
                    at += 1
                    back = ((back + 1) << 7) | (byte & 0x7F)
                deltas.append(zlib.decompressobj().decompress(data[at:]))
                offset = start - back
            elif kind == 7:
                base, at = data[at : at + 20], at + 20
                deltas.append(zlib.decompressobj().decompress(data[at:]))
                inside = self.offset(base)
                if inside is None:
                    found, body = repo.read(base.hex())
                    break
                offset = inside
            else:
                found, body = KINDS[kind], zlib.decompressobj().decompress(data[at:])
                break
        for d in reversed(deltas):
            body = patched(body, d)
        return found, body


def patched(base: bytes, delta: bytes) -> bytes:
    """A delta applied: copies from the base and inserted bytes."""
    def number(at):
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                return value, at

    _, at = number(0)
    size, at = number(at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            place = length = 0
            for i in range(4):
                if op >> i & 1:
                    place |= delta[at] << 8 * i
                    at += 1
            for i in range(3):
                if op >> (4 + i) & 1:
                    length |= delta[at] << 8 * i
                    at += 1
            out += base[place : place + (length or 0x10000)]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != size:
        raise ValueError("a delta doesn't give the size it states")
    return bytes(out)


class Repo:
    def __init__(self, root: str):
        git = os.path.join(root, ".git")
        self.git = git if os.path.isdir(git) else root
        folder = os.path.join(self.git, "objects", "pack")
        self.packs = [Pack(os.path.join(folder, p)) for p in sorted(os.listdir(folder)) if p.endswith(".pack")] if os.path.isdir(folder) else []

    @lru_cache(maxsize=256)  # noqa: B019  one repository a worker
    def read(self, name: str) -> tuple[str, bytes]:
        path = os.path.join(self.git, "objects", name[:2], name[2:])
        if os.path.exists(path):
            with open(path, "rb") as f:
                raw = zlib.decompress(f.read())
            head, _, body = raw.partition(b"\0")
            if hashlib.sha1(raw, usedforsecurity=False).hexdigest() != name:
                raise ValueError(f"object {name} is damaged")
            return head.split(b" ")[0].decode(), body
        for p in self.packs:
            if (at := p.offset(bytes.fromhex(name))) is not None:
                return p.read(at, self)
        raise KeyError(name)

    def resolve(self, ref: str = "HEAD") -> str | None:
        """The commit a reference or a full hash names; None if it has none yet."""
        for _ in range(10):
            if re.fullmatch(r"[0-9a-f]{40}", ref):
                return ref
            path = os.path.join(self.git, ref)
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    said = f.read().strip()
                ref = said[5:] if said.startswith("ref: ") else said
                continue
            packed = os.path.join(self.git, "packed-refs")
            if os.path.isfile(packed):
                with open(packed, encoding="utf-8") as f:
                    known = dict(reversed(x.split(" ", 1)) for x in f.read().splitlines() if x and x[0] not in "#^")
                if ref in known:
                    return known[ref]
            if not ref.startswith("refs/"):
                ref = f"refs/heads/{ref}"
                continue
            return None
        return None

    def commit(self, name: str) -> Commit:
        kind, body = self.read(name)
        if kind != "commit":
            raise ValueError(f"{name} is a {kind}")
        head, _, message = body.decode("utf-8", "replace").partition("\n\n")
        fields = [x.split(" ", 1) for x in head.split("\n") if " " in x and not x.startswith(" ")]
        author = next((v for k, v in fields if k == "author"), " <> 0 +0000")
        m = re.match(r"(.*?) ?<(.*?)> (-?\d+)", author)
        return Commit(name, next(v for k, v in fields if k == "tree"), tuple(v for k, v in fields if k == "parent"), m.group(1), m.group(2), int(m.group(3)), message.strip())

    def entries(self, tree: str) -> dict[str, tuple[str, str]]:
        """name -> (mode, hash) of a tree."""
        body, out, at = self.read(tree)[1], {}, 0
        while at < len(body):
            space, end = body.index(b" ", at), body.index(b"\0", at)
            out[body[space + 1 : end].decode("utf-8", "replace")] = (body[at:space].decode(), body[end + 1 : end + 21].hex())
            at = end + 21
        return out

    def differences(self, old: str | None, new: str | None, prefix: str = "") -> Iterator[tuple[str, str | None, str | None]]:
        """(path, old blob, new blob) of files that differ; equal subtrees aren't opened."""
        a, b = self.entries(old) if old else {}, self.entries(new) if new else {}
        for name in sorted(a.keys() | b.keys()):
            x, y = a.get(name), b.get(name)
            if x == y:
                continue
            path, trees = prefix + name, [t if t and t[0] == "40000" else None for t in (x, y)]
            files = [t[1] if t and t[0].startswith("100") else None for t in (x, y)]
            if any(trees):
                yield from self.differences(*(t[1] if t else None for t in trees), path + "/")
            if files[0] != files[1]:
                yield path, files[0], files[1]

    def log(self, ref: str = "HEAD", first_parent: bool = False) -> Iterator[Commit]:
        """Commits that can be reached, newest first by time."""
        import heapq

        start = self.resolve(ref)
        if start is None:
            return
        first = self.commit(start)
        heap, seen = [(-first.time, first.hash, first)], {start}
        while heap:
            c = heapq.heappop(heap)[2]
            yield c
            for p in c.parents[:1] if first_parent else c.parents:
                if p not in seen:
                    seen.add(p)
                    try:
                        parent = self.commit(p)
                    except KeyError:  # a shallow clone ends here
                        continue
                    heapq.heappush(heap, (-parent.time, p, parent))

    def merge_base(self, a: str, b: str) -> str | None:
        """The newest commit that both can reach."""
        left = {c.hash for c in self.log(a)}
        return next((c.hash for c in self.log(b) if c.hash in left), None)

    def lines(self, blob: str | None) -> list[bytes]:
        """Lines of a file; none of a missing or a binary one."""
        if blob is None:
            return []
        body = self.read(blob)[1]
        return [] if b"\0" in body[:8000] else body.splitlines()

    def blob_at(self, commit: Commit, path: str) -> str | None:
        at = commit.tree
        for i, part in enumerate(parts := path.split("/")):
            entry = self.entries(at).get(part)
            if entry is None or (entry[0] == "40000") != (i < len(parts) - 1):
                return None
            at = entry[1]
        return at

    def blame(self, path: str, ref: str = "HEAD") -> list[Commit]:
        """The commit each line of a file came with, along first parents."""
        walk = list(self.log(ref, first_parent=True))
        if not walk or (blob := self.blob_at(walk[0], path)) is None:
            return []
        now = self.lines(blob)
        owner: list[Commit | None] = [None] * len(now)
        open_ = list(range(len(now)))  # places in the final file of the lines of `now` not yet told
        places = dict(enumerate(open_))
        for c, before in zip(walk, [*walk[1:], None]):
            old_blob = self.blob_at(before, path) if before else None
            if old_blob == blob:
                continue
            old = self.lines(old_blob)
            kept = {}
            for m in difflib.SequenceMatcher(None, old, now, autojunk=False).get_matching_blocks():
                for i in range(m.size):
                    if m.b + i in places:
                        kept[m.a + i] = places.pop(m.b + i)
            for final in places.values():
                owner[final] = c
            places, now, blob = kept, old, old_blob
            if not places:
                break
        return [o for o in owner if o is not None]


@lru_cache(maxsize=4)
def opened(root: str) -> Repo:
    return Repo(root)


def commits(spark: SparkSession, root: str, ref: str = "HEAD", most: int | None = None) -> DataFrame:
    """COMMITS of a repository; `most` is a limit the caller asks for."""
    rows = []
    for c in Repo(root).log(ref):
        if most is not None and len(rows) == most:
            break
        rows.append((c.hash, list(c.parents), c.author, c.email, pd.Timestamp(c.time, unit="s", tz="UTC").to_pydatetime(), c.message))
    return spark.createDataFrame(rows, COMMITS)


def changes(found: DataFrame, root: str) -> DataFrame:
    """CHANGES of each commit against its first parent, as file, kind of change and line counts."""
    def run(frames):
        repo = opened(root)
        for frame in frames:
            rows = []
            for name in frame["hash"]:
                c = repo.commit(name)
                old = repo.commit(c.parents[0]).tree if c.parents else None
                for path, a, b in repo.differences(old, c.tree):
                    x, y = repo.lines(a), repo.lines(b)
                    same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
                    rows.append((name, c.author, pd.Timestamp(c.time, unit="s"), path, "added" if a is None else "removed" if b is None else "changed", len(y) - same, len(x) - same))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])

    return found.select("hash").repartition(64).mapInPandas(run, CHANGES)


def blame(files: DataFrame, root: str, ref: str = "HEAD") -> DataFrame:
    """BLAME of the lines of files (path, relative to the repository)."""
    def run(frames):
        repo = opened(root)
        for frame in frames:
            rows = [(p, i + 1, c.author, c.hash, pd.Timestamp(c.time, unit="s")) for p in frame["path"] for i, c in enumerate(repo.blame(p, ref))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLAME.split(", ")])

    return files.select("path").repartition(64).mapInPandas(run, BLAME)


def commit_files(found: DataFrame, changed: DataFrame, now) -> DataFrame:
    """hash, author, ts, age_days, file, as temporal measures take them; commits with several parents
    don't count. now: a timestamp column."""
    single = found.where(F.size("parents") <= 1).select("hash")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400.0)
    return changed.join(single, "hash", "left_semi").select("hash", "author", "ts", age.alias("age_days"), "file")
