"""The tracks that can be made of a corpus: what each needs, in which order they run, which are there."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Track:
    """A track by name: ``make`` (spark, folder) gives its rows; needs that begin with '_' are met outside."""

    name: str
    make: Callable[[SparkSession, str], DataFrame]
    needs: tuple[str, ...] = ()
    output: str = "annotation"
    evidence: str = "E5"


class Registry:
    def __init__(self, tracks: Iterable[Track] = ()):
        self.tracks: dict[str, Track] = {}
        for track in tracks:
            self.register(track)

    def register(self, track: Track) -> None:
        if track.name in self.tracks:
            raise ValueError(f"there is a track {track.name} already")
        self.tracks[track.name] = track

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """The named tracks, or all, with what they need, each after its needs; of free ones, by name."""
        wanted, todo = set(), list(self.tracks if names is None else names)
        while todo:
            name = todo.pop()
            if name not in self.tracks:
                raise KeyError(f"no track {name}")
            if name not in wanted:
                wanted.add(name)
                todo += [n for n in self.tracks[name].needs if not n.startswith("_")]
        out: list[str] = []
        while len(out) < len(wanted):
            free = sorted(n for n in wanted - set(out) if all(m.startswith("_") or m in out for m in self.tracks[n].needs))
            if not free:
                raise ValueError(f"tracks need each other: {', '.join(sorted(wanted - set(out)))}")
            out += free
        return out

    def analyse(self, spark: SparkSession, folder: str, sink: str, names: Iterable[str] | None = None, again: bool = False) -> dict[str, str]:
        """Every track in order, written to ``sink``/name; one that is there stays unless ``again``."""
        done = {}
        for name in self.order(names):
            path = f"{sink}/{name}"
            if not again and _there(spark, path):
                done[name] = "computed"
                continue
            self.tracks[name].make(spark, folder).write.mode("overwrite").parquet(path)
            done[name] = "made"
        return done

    def status(self, spark: SparkSession, rows: DataFrame, key: str, track: str, keys: DataFrame) -> DataFrame:
        """(key, track, status) for each of ``keys`` and each track: computed if ``rows`` hold any, else pending."""
        names = spark.createDataFrame([(n,) for n in sorted(self.tracks)], "track string")
        there = rows.select(F.col(key), F.col(track).alias("track")).distinct().withColumn("status", F.lit("computed"))
        both = keys.select(key).distinct().join(F.broadcast(names)).join(there, [key, "track"], "left")
        return both.select(key, "track", F.coalesce("status", F.lit("pending")).alias("status"))


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def default() -> Registry:
    """The tracks of this package."""
    from lexiloom.plans import q_text, q_tracks

    return Registry([
        Track("lexical", q_text.lexical_stats), Track("dialogue", q_tracks.dialogue_spans), Track("sentiment", q_tracks.sentiment_spans), Track("narrative_arc", q_text.function_word_arc, output="vector"), Track("topics", q_tracks.topics),
        Track("coreference", q_tracks.coreference_chains, ("_entities",)), Track("rqa", q_tracks.rqa_windows, output="vector"), Track("self_similarity", q_tracks.chunk_similarity, output="matrix"), Track("syntax", q_text.sentence_windows),
        Track("alphabet", q_tracks.alphabet, ("sentiment", "lexical", "dialogue", "topics"), "sequence"), Track("lithmm", q_tracks.hidden_states, ("sentiment", "lexical", "dialogue", "topics")), Track("compartments", q_tracks.label_compartments, ("self_similarity",)),
    ])
