"""Cell references, sheet names and output paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a file name must not hold.
INVALID_IN_NAME = r'[<>:"/\\|?*\x00-\x1F ]'

_LETTERS = 26
_ALPHABET = [chr(ord("A") + i) for i in range(_LETTERS)]
_ONE_OR_TWO = ",".join(_ALPHABET + [a + b for a in _ALPHABET for b in _ALPHABET])


def column_letters(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to three letters.

    Looked up in a constant array: spelled out as arithmetic it alone makes the generated code
    of a typing stage too long for the JVM to compile.
    """
    names = F.split(F.lit(_ONE_OR_TWO), ",", -1)
    short = len(_ALPHABET) * (len(_ALPHABET) + 1)
    pairs = _LETTERS * _LETTERS
    above = index - short
    long = F.concat(
        F.get(names, F.floor(above / F.lit(float(pairs))).cast("int")), F.get(names, above % pairs + _LETTERS)
    )
    return F.when(index < short, F.get(names, index)).otherwise(long)


def cell_ref(col: Column, row: Column) -> Column:
    """0-based column and 1-based row -> B7."""
    return F.concat(column_letters(col), row.cast("string"))


def ref_column(ref: Column) -> Column:
    """0-based column of a reference; 0 without letters."""
    letters = F.split(F.regexp_extract(ref, r"\A([A-Z]+)", 1), "")
    index = F.aggregate(letters, F.lit(0), lambda acc, x: acc * _LETTERS + F.ascii(x) - 64)
    return F.when(ref.rlike(r"\A[A-Z]"), index - 1).otherwise(0).cast("int")


def safe_sheet_name(name: Column) -> Column:
    """A sheet name fit for a file name."""
    clean = F.regexp_replace(name, INVALID_IN_NAME, "_")
    return F.when(F.coalesce(name, F.lit("")) == "", "Sheet").otherwise(clean)


def path_folder(path: Column) -> Column:
    """Folder with its final slash, or nothing."""
    return F.regexp_extract(path, r"\A(.*[/\\])?", 1)


def path_base(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"\.[^.]*\z", "")


def path_extension(path: Column) -> Column:
    """Extension with its point, lower case, or nothing."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def output_path(path: Column, folder: Column | None = None) -> Column:
    """Text goes to a workbook and a workbook to text, in ``folder`` or next to the source."""
    extension = F.when(path_extension(path) == ".xlsx", ".csv").otherwise(".xlsx")
    target = path_folder(path) if folder is None else F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))
    return F.concat(target, path_base(path), extension)


def sheet_path(path: Column, sheet: Column) -> Column:
    """Output path of one sheet: base name, sheet name, extension."""
    extension = F.regexp_extract(path, r"(\.[^./\\]*)\z", 1)
    return F.concat(path_folder(path), path_base(path), F.lit("_"), safe_sheet_name(sheet), extension)
