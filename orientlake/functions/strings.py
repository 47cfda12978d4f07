"""Names of images, stacks and micrographs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def image_index(name: Column) -> Column:
    """Number before the first ``@``; NULL when the name has none."""
    text = F.regexp_extract(name, r"^\s*(\d+)\s*@", 1)
    return F.when(text != "", text.cast("bigint"))


def image_stack(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"^[^@]*@", ""))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def particle_id(name: Column) -> Column:
    """Integer index and stack basename: the same wherever the files lie."""
    return F.concat(image_index(name).cast("string"), F.lit("_"), basename(image_stack(name)))


def micrograph_key(path: Column) -> Column:
    return basename(F.regexp_replace(path, r"^[^@]*@", ""))


def micrograph_below(path: Column, root: str | None) -> Column:
    """Path relative to ``root`` when it lies below it, else its basename."""
    if not root:
        return basename(path)
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(basename(path))


def rebase(name: Column, folder: str, keep_basename: bool = True, remove_zeros: bool = True) -> Column:
    """Image name with its stack moved below ``folder``."""
    index = F.regexp_extract(name, r"^([^@]*)@", 1)
    if remove_zeros:
        index = image_index(name).cast("string")
    stack = image_stack(name)
    if keep_basename:
        stack = basename(stack)
    if folder:
        stack = F.when(stack.startswith("/"), stack).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), stack))
    return F.when(name.contains("@"), F.concat(index, F.lit("@"), stack)).otherwise(stack)


def coordinate_cell(value: Column, tolerance: float) -> Column:
    """Coordinate on a grid of the given tolerance, halves to even."""
    return F.rint(value / F.lit(float(tolerance))).cast("bigint")


def stack_reference(name: Column, folder: str, absolute: bool) -> Column:
    """Image name with its stack written as an absolute path, or relative to the table beside it."""
    stack = basename(image_stack(name))
    if absolute:
        stack = F.concat(F.lit(folder.rstrip("/") + "/"), stack)
    return F.concat(F.substring_index(name, "@", 1), F.lit("@"), stack)


def output_path(path: Column, folder: str) -> Column:
    """Absolute paths lose their folders, relative ones are mirrored below ``folder``."""
    tail = F.when(path.startswith("/"), basename(path)).otherwise(path)
    return F.concat(F.lit(folder.rstrip("/") + "/"), tail)
