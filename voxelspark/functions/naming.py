"""Names: classes, teeth, scan labels, failure kinds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id, key, name, smallest volume kept (cm3).
CLASSES = (
    (1, "mandible", "Mandible", 1.0),
    (2, "upper_skull", "Upper Skull", 1.0),
    (3, "upper_teeth", "Upper Teeth", 0.02),
    (4, "lower_teeth", "Lower Teeth", 0.02),
    (5, "mandibular_canal", "Mandibular Canal", 0.02),
    (6, "maxillary_sinus", "Maxillary Sinus", 0.20),
    (7, "nasal_cavity", "Nasal Cavity", 0.20),
    (8, "pharynx", "Pharynx", 0.50),
    (9, "soft_palate", "Soft Palate", 0.10),
)
TOOTH_TYPES = ("Central Incisor", "Lateral Incisor", "Canine", "First Premolar",
               "Second Premolar", "First Molar", "Second Molar", "Third Molar")
QUADRANTS = ("Upper Right", "Upper Left", "Lower Left", "Lower Right")
IMPLANT, IMPLANT_CROWN, BRIDGE = 33, 34, 35
PROSTHESES = {33: "implant", 34: "implant_crown", 35: "bridge"}
UPPER_IDS, LOWER_IDS = (1, 16), (17, 32)
LABEL_SUFFIXES = (".nii.gz", ".zip", ".mha", ".mhd", ".nrrd", ".nii", ".dcm")
GENERIC_NAMES = ("ct", "dicom", "data", "dcm", "cbct", "kt", "vol_1", "vol_2", "vol_3", "scan", "images")
OUT_OF_MEMORY_MARKS = ("out of memory", "outofmemory", "failed to allocate", "allocation failed",
                       "hiperroroutofmemory", "cudaerrormemoryallocation", "e_outofmemory",
                       "insufficient", "8007000e", "887a0004")
DEVICE_LOST_MARKS = ("887a0005", "887a0006", "887a0007", "887a0020", "device_removed", "device removed",
                     "device_hung", "device hung", "device_reset", "devicelost", "device lost")


def class_table() -> Column:
    """The class dimension as an array column of structs: exploded where needed, never joined."""
    return F.array(*[F.struct(
        F.lit(i).alias("id"), F.lit(k).alias("key"), F.lit(n).alias("name"),
        F.lit(m).alias("min_cm3")) for i, k, n, m in CLASSES])


def min_volume(class_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c[3]) for c in CLASSES]), class_id.cast("int"))


def class_id_of(name: Column) -> Column:
    """A key or a number to the class id; null when unknown."""
    text = F.lower(F.trim(name))
    pairs = [F.lit(v) for c in CLASSES for v in (c[1], c[0])]
    by_key = F.element_at(F.create_map(*pairs), text)
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.when(number.between(1, len(CLASSES)), number), by_key)


def resolve_classes(requests: DataFrame, names: str = "names") -> DataFrame:
    """Adds ``class_ids`` (repeats kept, in order) and ``unknown``, the first bad name.

    Nothing asked, or ``all`` reached before a bad name, means every class.
    """
    every = F.array(*[F.lit(c[0]) for c in CLASSES])
    asked = F.transform(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda n: F.lower(F.trim(n)))
    ids = F.transform(asked, class_id_of)
    known = F.transform(asked, lambda n: (n == "all") | class_id_of(n).isNotNull())
    bad, whole = F.array_position(known, False), F.array_position(asked, "all")
    takes_all = (F.size(asked) == 0) | ((whole > 0) & ((bad == 0) | (whole < bad)))
    return requests.withColumns({
        "class_ids": F.when(takes_all, every).when(bad == 0, ids),
        "unknown": F.when(~takes_all & (bad > 0), F.element_at(asked, F.greatest(bad, F.lit(1)).cast("int")))})


def fdi_number(tooth_id: Column) -> Column:
    """1..32 to the two-digit number 11..48."""
    t = tooth_id.cast("int") - 1
    return ((F.floor(t / 8) + 1) * 10 + t % 8 + 1).cast("int")


def tooth_name(tooth_id: Column) -> Column:
    n = fdi_number(tooth_id)
    side = F.element_at(F.array(*[F.lit(q) for q in QUADRANTS]), F.floor(n / 10).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in TOOTH_TYPES]), (n % 10).cast("int"))
    return F.format_string("Tooth %d (%s %s)", n, side, kind)


def scan_label(path: Column) -> Column:
    """Last path part without its volume suffix; the parent is put before a generic name."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: ~p.isin("", "."))
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    suffix = "(?i)(" + "|".join(s.replace(".", r"\.") for s in LABEL_SUFFIXES) + ")$"
    base = F.regexp_replace(base, suffix, "")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    named = F.when(F.lower(base).isin(*GENERIC_NAMES) & (parent != ""), F.concat(parent, F.lit("/"), base)).otherwise(base)
    return F.when(named == "", "scan").otherwise(named)


def _any_of(text: Column, marks) -> Column:
    return text.rlike("|".join(marks))


def failure_kind(line: Column) -> Column:
    """out_of_memory, device_lost or other, by marks in the text."""
    text = F.lower(line)
    return (F.when(_any_of(text, OUT_OF_MEMORY_MARKS), "out_of_memory")
            .when(_any_of(text, DEVICE_LOST_MARKS), "device_lost").otherwise("other"))
