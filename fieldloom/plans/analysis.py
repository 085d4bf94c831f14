"""The whole analysis as one call: options, build folders, reading, reports."""

from __future__ import annotations

import importlib.metadata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldloom.operators.property_access import classes_report
from fieldloom.plans import report
from fieldloom.plans.checkpoints import checkpoint
from fieldloom.sources import classfile, scan

#: Where builds put compiled classes, relative to a project.
BUILD_FOLDERS = ("build/classes/kotlin/main", "build/classes/java/main")
AGGREGATE_ROOT = "Lexample/AggregateRoot;"


def version(package: str = "fieldloom") -> str:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return "1.0.0"


@dataclass(frozen=True)
class Options:
    """What to read (nothing: the project's build folders), what to look for, and where the report goes."""

    output: str | None = None
    class_paths: tuple[str, ...] = ()
    form: str = "JSON"
    verbose: bool = False
    roles: tuple[str, ...] = (AGGREGATE_ROOT,)


def class_folders(spark: SparkSession, project: str, options: Options = Options()) -> list[str]:
    """The options' folders, else the build folders that exist, else all of these; other than folders are left out."""
    paths = [f"{project}/{p}" for p in options.class_paths or BUILD_FOLDERS]
    there = [p for p in paths if classfile.is_folder(spark, p)]
    return there if options.class_paths else there or paths


def analyse(spark: SparkSession, project: str, options: Options = Options()) -> DataFrame:
    """The report's rows; written and logged as the options say."""
    if options.form.upper() not in report.FORMATS:
        raise ValueError(f"unknown format: {options.form}")
    folders = [p for p in class_folders(spark, project, options) if classfile.is_folder(spark, p)]
    # Facts are parsed once, by ranges of files where the store can be opened, else through Spark's reader of whole files.
    read = scan.read if folders and all(map(scan.opens, folders)) else classfile.read
    t = classfile.tables(checkpoint(read(spark, *folders)))
    found = classes_report(t["classes"], t["methods"], t["insns"], list(options.roles))
    if options.output:
        report.write(found, options.output, options.form)
    if options.verbose:
        report.log(found)
    return found
