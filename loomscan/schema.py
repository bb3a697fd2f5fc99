"""Names, bit masks and schemas of the metric store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION_TYPES = {"global": 1, "class": 2, "struct": 4, "namespace": 8, "function": 16, "interface": 32}
SPAN_KINDS = {"comment": 1, "string": 2, "preprocessor": 4, "code": 8}
ANY = 255

#: A row a file (region_id null) and one a region; children: types of the regions directly inside, inside: their length in all.
SPAN = "struct<kind:int,begin:int,end:int,text:string>"
REGIONS = (
    "path string, lang string, region_id int, parent_id int, name string, group_id int, offset_begin int, offset_end int, "
    f"line_begin int, line_end int, cursor int, checksum long, procerrors int, children array<int>, inside long, spans array<{SPAN}>"
)


def mask_of(names: str) -> int:
    """Bits of comma-separated region types; `any` is all."""
    out = 0
    for name in filter(None, (x.strip() for x in names.split(","))):
        if name != "any" and name not in REGION_TYPES:
            raise ValueError(f"unknown region type: {name}")
        out |= ANY if name == "any" else REGION_TYPES[name]
    return out


def type_names(group_id: Column) -> Column:
    """Comma-separated names of the bits that are set."""
    return F.array_join(F.array_compact(F.array(*[F.when(group_id.bitwiseAND(b) != 0, n) for n, b in REGION_TYPES.items()])), ", ")


@dataclass(frozen=True)
class Field:
    namespace: str
    name: str
    kind: str = "long"
    non_zero: bool = False
    regions: bool = True

    @property
    def column(self) -> str:
        return f"{self.namespace}:{self.name}"


@dataclass
class Snapshot:
    """Tables of one code revision.

    files: path, checksum, file-scope metric columns; regions: path, region_id, parent_id, name, group_id, line_begin,
    line_end, cursor, checksum, region-scope metric columns; suppress: path, region_id (null: the file's), metrics
    array<string>; properties: property, value. tokens: the tokenizer's rows behind them, where these are kept.
    """

    files: DataFrame
    regions: DataFrame
    fields: list[Field]
    suppress: DataFrame | None = None
    properties: dict[str, str] = field(default_factory=dict)
    tokens: DataFrame | None = None

    def numeric(self, regions: bool) -> list[Field]:
        return [f for f in self.fields if f.regions == regions and f.kind != "string"]

    def field_of(self, name: str) -> Field:
        for f in self.fields:
            if f.column == name:
                return f
        raise ValueError(f"metric isn't in the snapshot: {name}")
