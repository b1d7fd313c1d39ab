"""What all searches have in common, and a registry of them: indexes are fitted, set, measured and searched alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from seekspark.operators import binary, ivf, lexical, vector
from seekspark.sources.tables import check_vectors

#: From this size on, lists are searched in their files rather than in memory.
AUTO_DISK_BYTES = 256 << 20
STORAGES = ("ram", "disk", "auto")


class Retriever(Protocol):
    """``queries``: (query_id, text) for words, (query_id, vector) for vectors; a search gives a run."""

    slug: str

    def add_documents(self, docs: DataFrame | None, vectors: DataFrame | None = None) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def set_search_params(self, **params: object) -> None: ...

    def size_bytes(self) -> int: ...


def _fitted(index, name: str):
    if index is None:
        raise RuntimeError(f"{name} is searched before documents were added")
    return index


def _checked(vectors: DataFrame | None) -> tuple[DataFrame, int]:
    if vectors is None:
        raise ValueError("this index needs vectors")
    return vectors, check_vectors(vectors)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What the files under ``path`` take."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


@dataclass
class Words:
    """BM25."""

    k1: float = 0.9
    b: float = 0.4
    method: str = "lucene"
    slug: str = "bm25"
    index: lexical.Bm25 | None = None

    def add_documents(self, docs: DataFrame, vectors: DataFrame | None = None) -> None:
        self.index = lexical.Bm25.fit(docs, self.k1, self.b, self.method)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return _fitted(self.index, self.slug).search(queries, k)

    def set_search_params(self, **params: object) -> None:
        """There are none."""

    def size_bytes(self) -> int:
        return self.index.size_bytes() if self.index else 0


@dataclass
class Flat:
    """Exact inner products."""

    slug: str = "flat"
    vectors: DataFrame | None = None
    dim: int = 0

    def add_documents(self, docs: DataFrame | None, vectors: DataFrame | None = None) -> None:
        self.vectors, self.dim = _checked(vectors)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vector.exact_topk(_fitted(self.vectors, self.slug), queries, k)

    def set_search_params(self, **params: object) -> None:
        """There are none."""

    def size_bytes(self) -> int:
        return 4 * self.dim * self.vectors.count() if self.vectors is not None else 0


@dataclass
class Ivfpq:
    """Inverted lists of product-quantised residuals, refined exactly."""

    nlist: int | None = None
    m: int = 48
    bits: int = 4
    nprobe: int = 8
    k_factor: int = 4
    slug: str = "ivfpq"
    index: ivf.ProductIndex | None = None

    def add_documents(self, docs: DataFrame | None, vectors: DataFrame | None = None) -> None:
        vectors, dim = _checked(vectors)
        n = vectors.count()
        self.index = ivf.ProductIndex.fit(vectors, self.nlist or ivf.default_nlist(n), ivf.parts_of(dim, self.m), self.bits)
        self.dim, self.n = dim, n

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return _fitted(self.index, self.slug).search(queries, k, self.nprobe, self.k_factor)

    def set_search_params(self, **params: object) -> None:
        """nprobe and k_factor; others are ignored."""
        self.nprobe, self.k_factor = int(params.get("nprobe", self.nprobe)), int(params.get("k_factor", self.k_factor))

    def size_bytes(self) -> int:
        """That of the vectors, which the exact refining keeps."""
        return 4 * self.dim * self.n if self.index else 0


@dataclass
class Bbq:
    """Binary lists in files, searched there or in memory."""

    path: str
    m: int | None = None
    nlist: int | None = None
    nbits: int = 1
    nprobe: int = 8
    k_factor: int = 4
    use_rescore: bool = True
    auto_disk_bytes: int = AUTO_DISK_BYTES
    slug: str = "bbq"
    stored: binary.BinaryLists | None = None
    held: DataFrame | None = field(default=None, repr=False)

    def add_documents(self, docs: DataFrame | None, vectors: DataFrame | None = None, centroids: DataFrame | None = None) -> None:
        vectors, dim = _checked(vectors)
        self.close()
        binary.BinaryLists.fit(vectors, dim, self.m or ivf.code_parts(dim), self.nlist, centroids, self.nbits).save(self.path)
        self.stored = binary.BinaryLists.load(vectors.sparkSession, self.path)

    def resolve(self, mode: str) -> str:
        if mode not in STORAGES:
            raise ValueError(f"unknown mode {mode!r}; there are {STORAGES}")
        return ("disk" if self.size_bytes() >= self.auto_disk_bytes else "ram") if mode == "auto" else mode

    def search(self, queries: DataFrame, k: int, mode: str = "auto") -> DataFrame:
        """``mode``: disk reads the probed lists, ram keeps all lists in the executors' memory."""
        lists = _fitted(self.stored, self.slug)
        if self.resolve(mode) == "ram":
            if self.held is None:
                self.held = lists.rows.persist()
            lists = binary.BinaryLists(self.held, lists.centroids, lists.cuts, lists.dim)
        return lists.search(queries, k, self.nprobe, self.k_factor, self.use_rescore)

    def set_search_params(self, **params: object) -> None:
        """nprobe, k_factor and use_rescore; others are ignored."""
        self.nprobe, self.k_factor = int(params.get("nprobe", self.nprobe)), int(params.get("k_factor", self.k_factor))
        self.use_rescore = bool(params.get("use_rescore", self.use_rescore))

    def size_bytes(self) -> int:
        return stored_bytes(self.stored.rows.sparkSession, self.path) if self.stored else 0

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None


RETRIEVERS: dict[str, Callable[..., Retriever]] = {"bm25": Words, "flat": Flat, "ivfpq": Ivfpq, "bbq": Bbq}


def get_retriever(slug: str, **settings: object) -> Retriever:
    if slug not in RETRIEVERS:
        raise KeyError(f"no retriever {slug!r}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[slug](**settings)
