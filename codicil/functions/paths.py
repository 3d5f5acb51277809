"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import unicode as uc


def doc_id(path: Column) -> Column:
    """Stable identity of a path, equal for composed and decomposed spellings."""
    return F.sha2(uc.nfc(path), 256)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _suffix(file_name: Column) -> Column:
    # A leading dot (".profile") or trailing dot does not start a suffix.
    return F.regexp_extract(file_name, r"[^.].*?(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(_suffix(name(path)))


def stem(path: Column) -> Column:
    file_name = name(path)
    return F.substring(file_name, F.lit(1), F.length(file_name) - F.length(_suffix(file_name)))


def parent(path: Column) -> Column:
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(name(path)) - 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def path_parts(path: Column) -> Column:
    return F.struct(
        stem(path).alias("title"), extension(path).alias("file_type"), parent(path).alias("parent")
    )


def category(ext: Column, table: dict[str, str] | None = None) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in (table or fv.CATEGORY_BY_EXTENSION).items() for x in kv])
    return F.coalesce(mapping[F.lower(ext)], F.lit(fv.DEFAULT_CATEGORY))


def ancestors(path: Column) -> Column:
    """The path itself and every folder above it, for prefix equi-joins."""
    depth = F.regexp_count(path, F.lit("/")) + 1
    above = F.transform(F.sequence(F.lit(1), depth), lambda n: F.call_function("substring_index", path, F.lit("/"), n))
    return F.transform(above, lambda a: F.when(a == "", F.lit("/")).otherwise(a))


def route(path: Column, size_mb: Column) -> Column:
    """struct(route, error): which reader takes a file, or why none does."""
    readers: dict[str, str] = {}
    for reader, extensions in fv.READER_EXTENSIONS:
        for ext in extensions:
            readers.setdefault(ext, reader)
    ext = extension(path)
    reader_of = F.create_map(*[F.lit(x) for kv in readers.items() for x in kv])
    modern = F.create_map(*[F.lit(x) for kv in fv.LEGACY_OFFICE.items() for x in kv])
    too_large = size_mb > fv.MAX_FILE_MB
    error = (
        F.when(
            too_large,
            F.format_string(f"File too large: %.1f MB exceeds {fv.MAX_FILE_MB} MB limit", size_mb.cast("double")),
        )
        .when(reader_of[ext].isNotNull(), F.lit(None).cast("string"))
        .when(
            modern[ext].isNotNull(),
            F.format_string(
                "Legacy Office format (%s) is not supported — re-save the file as %s to index it.", ext, modern[ext]
            ),
        )
        .otherwise(F.concat(F.lit("Unsupported file type: "), ext))
    )
    return F.struct(F.when(~too_large, reader_of[ext]).alias("route"), error.alias("error"))


def is_scannable(
    path: Column,
    supported: tuple[str, ...] = fv.SCANNED_EXTENSIONS,
    excluded_dirs: tuple[str, ...] = fv.EXCLUDED_DIRECTORIES,
    excluded_files: tuple[str, ...] = (),
    excluded_extensions: tuple[str, ...] = (),
) -> Column:
    """Whether a scan keeps the file: folder rules, hidden names, extensions.

    Folder patterns match exactly; only patterns starting with a dot also
    match as a suffix.
    """
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d != "")
    exact = [d.lower() for d in excluded_dirs]
    endings = [d for d in exact if d.startswith(".")]

    def skipped(folder: Column) -> Column:
        lowered = F.lower(folder)
        rule = F.startswith(folder, F.lit(".")) | lowered.isin(exact)
        for ending in endings:
            rule = rule | F.endswith(lowered, F.lit(ending))
        return rule

    return ~F.exists(folders, skipped) & is_scannable_name(name(path), supported, excluded_files, excluded_extensions)


def is_scannable_name(
    file_name: Column,
    supported: tuple[str, ...] = fv.SCANNED_EXTENSIONS,
    excluded_files: tuple[str, ...] = (),
    excluded_extensions: tuple[str, ...] = (),
) -> Column:
    ext = extension(file_name)
    keep = ~F.startswith(file_name, F.lit(".")) & ext.isin(*supported)
    if excluded_files:
        keep = keep & ~file_name.isin(*excluded_files)
    if excluded_extensions:
        keep = keep & ~ext.isin(*excluded_extensions)
    return keep
