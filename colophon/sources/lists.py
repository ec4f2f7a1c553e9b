"""Lists of records, page by page, as a Spark streaming source of its own.

A list (a set of the provider, or the whole) is read in order: each page names the token of the next. A micro-batch is
a round: one partition for each list still open reads some of its pages from its token on, inside the executor, with
retries and growing pauses in place, so that pages never overtake each other. The tokens at which a round begins are
its offset and lie in the checkpoint; a round that runs again begins at the same ones. Where a list got to is left by
its partition as a small file in ``state``, from which the next round is planned, also after a stop in mid-list.

``fetch(set_spec, token)`` gives the page as text; an empty token asks for the first one. It is shipped to executors.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
import time
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PAGE = "set_spec string, page int, token string, status string, tries int, xml string"

_TOKEN = re.compile(r"<(?:[\w.-]+:)?resumptionToken(?:\s[^>]*)?>(.*?)</", re.DOTALL)
_ERROR = re.compile(r"<(?:[\w.-]+:)?error[^>]*\scode\s*=\s*[\"']([^\"']*)")
_LIST = re.compile(r"<(?:[\w.-]+:)?ListRecords[\s>]")


def next_token(page: str) -> str | None:
    """The token of the page after this one, or None at the end of the list."""
    found = _TOKEN.findall(page)
    token = html.unescape(found[-1]).strip() if found else ""
    return token or None


def status_of(page: str) -> str:
    """The status of a response, as ``oai.page_status`` has it for columns."""
    error = _ERROR.search(page)
    if error:
        return "NO_MATCHING_QUERY" if error[1] == "noRecordsMatch" else "ERROR_FATAL"
    return "OK" if _LIST.search(page) else "ERROR_RETRY"


class _State:
    """Small files that say where each list got to in each round."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _folder(self, round_: int) -> str:
        return f"{self.root}/{round_:08d}"

    def _write(self, name: str, what) -> None:
        self.fs.create_dir(name.rsplit("/", 1)[0])
        with self.fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(what).encode())
        self.fs.move(f"{name}.part", name)

    def _read(self, name: str):
        with self.fs.open_input_stream(name) as file:
            return json.loads(file.read())

    def put(self, round_: int, place: dict) -> None:
        """Note where a list is after a round."""
        self._write(f"{self._folder(round_)}/{hashlib.sha256(place['set'].encode()).hexdigest()}.place", place)

    def get(self, round_: int) -> dict[str, dict]:
        """The places after a round, by list."""
        there = fs.FileSelector(self._folder(round_), allow_not_found=True)
        places = [self._read(f.path) for f in self.fs.get_file_info(there) if f.path.endswith(".place")] + self.plan(round_)["others"]
        return {p["set"]: p for p in sorted(places, key=lambda p: p["set"])}

    def put_plan(self, offset: dict, others: list[dict]) -> None:
        """What a round reads, and the places of the lists that it leaves alone."""
        self._write(f"{self._folder(offset['round'])}/plan", {"offset": offset, "others": others})

    def plan(self, round_: int) -> dict:
        return self._read(f"{self._folder(round_)}/plan")

    def rounds(self) -> list[int]:
        there = fs.FileSelector(self.root, allow_not_found=True)
        return sorted(int(f.base_name) for f in self.fs.get_file_info(there) if f.base_name.isdigit())

    def forget(self, before: int) -> None:
        for r in self.rounds():
            if r < before:
                self.fs.delete_dir(self._folder(r))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, fetch: Callable[[str, str], str], wait: Callable[[float], None]):
        self.sets = json.loads(options["sets"])
        self.pages, self.tries = int(options["pages"]), int(options["tries"])
        self.state, self.fetch, self.wait, self.new = options["state"], fetch, wait, True

    def initialOffset(self) -> dict:
        return {"round": 0, "places": []}

    def latestOffset(self) -> dict:
        """The round to read next with the places it begins at, or the last round again if no list is open.

        A list whose page could not be read stays at its token; it is open again when a query starts anew.
        """
        state = _State(self.state)
        last = max(state.rounds(), default=0)
        offset = state.plan(last)["offset"] if last else self.initialOffset()
        places = state.get(last) if last else {s: {"set": s, "token": "", "page": 0, "failed": False} for s in self.sets}
        if any(s not in places for s, _, _ in offset["places"]):
            return offset  # planned and not read yet
        open_ = {s: p for s, p in places.items() if p["token"] is not None and (self.new or not p["failed"])}
        if not open_:
            return offset
        self.new = False
        offset = {"round": last + 1, "places": [[s, p["token"], p["page"]] for s, p in open_.items()]}
        state.put_plan(offset, [p for s, p in places.items() if s not in open_])
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((s, token, page, end["round"])) for s, token, page in end["places"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        set_spec, token, page, round_ = partition.value
        failed = False
        for _ in range(self.pages):
            for tries in range(self.tries):
                if tries:
                    self.wait(min(2.0 ** (tries - 1), 300.0))
                try:
                    xml = self.fetch(set_spec, token)
                    status = status_of(xml)
                except OSError as error:
                    xml, status = str(error), "ERROR_RETRY"
                if status != "ERROR_RETRY":
                    break
            yield set_spec, page, token, status, tries + 1, xml
            if status.startswith("ERROR"):
                failed = True
                break
            token, page = next_token(xml) if status == "OK" else None, page + 1
            if token is None:
                break
        _State(self.state).put(round_, {"set": set_spec, "token": token, "page": page, "failed": failed})

    def commit(self, end: dict) -> None:
        _State(self.state).forget(end["round"])


def register(spark: SparkSession, name: str, fetch: Callable[[str, str], str], wait: Callable[[float], None] = time.sleep) -> None:
    """Make ``spark.readStream.format(name)`` a source of pages that ``fetch`` gives."""

    class Lists(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(dict(self.options), fetch, wait)

    # The process that plans a streaming source gets no shipped files, so what it needs of this module travels with the class.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Lists)


def stream_lists(spark: SparkSession, name: str, sets: list[str], state: str, pages: int = 100, tries: int = 3) -> DataFrame:
    """The pages of the lists as a stream: ``pages`` of each list in a round, each tried ``tries`` times.

    ``state`` is a folder that driver and executors share, kept with the checkpoint.
    """
    options = {"sets": json.dumps(sets), "state": state, "pages": pages, "tries": tries}
    return spark.readStream.format(name).options(**options).load()


def folder_fetch(root: str) -> Callable[[str, str], str]:
    """A fetch that replays pages kept as ``root``/set=S/page=N/ text files; tokens are page numbers."""

    def fetch(set_spec: str, token: str) -> str:
        store, path = fs.FileSystem.from_uri(root)
        there = fs.FileSelector(f"{path}/set={set_spec}/page={int(token or 0)}")
        parts = sorted(f.path for f in store.get_file_info(there) if f.base_name.startswith("part-"))
        return "".join(store.open_input_stream(p, compression=None).read().decode() for p in parts)

    return fetch
