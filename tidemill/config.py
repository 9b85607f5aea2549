"""Run options and the paths and names that keep trial runs apart from full runs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RunOptions:
    """sample_size 0 means all rows; is_trial picks separate paths and collections."""

    sample_size: int = 0
    is_trial: bool = False


TRIAL_RUN = RunOptions(sample_size=10, is_trial=True)
SMALL_RUN = RunOptions(sample_size=100)
MEDIUM_RUN = RunOptions(sample_size=1000)


@dataclass(frozen=True)
class Layout:
    """Where things live under one base folder."""

    base: str
    collection_prefix: str = ""

    def product(self, name: str, options: RunOptions = RunOptions()) -> str:
        folder = f"{self.base}/trial" if options.is_trial else self.base
        return f"{folder}/{name}.parquet"

    def twin(self, name: str, options: RunOptions = RunOptions()) -> str:
        folder = f"{self.base}/synthetic/trial" if options.is_trial else f"{self.base}/synthetic"
        return f"{folder}/{name}.parquet"

    def snapshot(self, name: str, options: RunOptions = RunOptions()) -> str:
        trial = "trial/" if options.is_trial else ""
        return f"{self.base}/{trial}intermediate/{name}.parquet"

    def results(self, name: str, run_id: str) -> str:
        return f"{self.base}/checkpoints/{name}/{run_id}"

    def collection(self, name: str, options: RunOptions = RunOptions()) -> str:
        return f"{self.base}/collections/{collection_name(name, options, self.collection_prefix)}"


def collection_name(
    name: str, options: RunOptions = RunOptions(), prefix: str = ""
) -> str:
    """`dev_` + `speeches` gives `Devspeeches`; trial runs get their own name."""
    joined = f"{prefix}{name}".replace("_", "")
    titled = "".join(word.title() for word in joined.split())
    return f"{titled}Trial" if options.is_trial else titled
