"""Known data sets: training file, test file, declared dimension."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dataset:
    name: str
    train: str
    test: str | None
    dim: int


#: Training file, test file and dimension of the public benchmark sets.
BENCHMARKS = [
    ("w8a", "w8a.t", 300),
    ("a9a", "a9a.t", 123),
    ("news20.binary", "news20.binary", 1335191),
    ("real-sim", "real-sim", 20958),
    ("rcv1_test.binary", "rcv1_train.binary", 47236),
    ("mnist.scale", "mnist.scale.t", 784),
    ("dominionstats.01scale_r2.train", "dominionstats.01scale_r2.test", 596),
    ("tweet.train", "tweet.test", 52242),
    ("webspam_wc_normalized_unigram.svm", "webspam_wc_normalized_unigram.svm", 254),
    ("kytea-msr_first_500k.train", "kytea-msr.test", 8683737),
    ("kytea-msr_first_1M.train", "kytea-msr.test", 8683737),
]


class Catalog:
    """Data sets by name, under one folder."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.known: dict[str, Dataset] = {}

    @classmethod
    def benchmarks(cls, folder: str) -> Catalog:
        """The public benchmark sets, by the names of their training files."""
        out = cls(folder)
        for train, test, dim in BENCHMARKS:
            out.add(train, train, test, dim)
        return out

    def add(self, name: str, train: str, test: str | None = None, dim: int = 0) -> Dataset:
        self.known[name] = found = Dataset(name, f"{self.folder}/{train}", f"{self.folder}/{test}" if test else None, dim)
        return found

    def __getitem__(self, name: str) -> Dataset:
        return self.known[name]

    def __iter__(self):
        return iter(self.known.values())
