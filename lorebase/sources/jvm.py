"""SQL functions written in Java: Spark's own compiler makes the classes on the driver, executors get them as a jar of the session."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .durable import filesystem, shared_dir


def functions(spark: SparkSession, source: Path, classes: dict[str, str]) -> dict[str, str]:
    """SQL names of the nested ``classes`` (name -> type of the result) of a Java file, made known to the session."""
    text = source.read_text()
    mark = hashlib.sha256(text.encode()).hexdigest()[:12]
    names = {k: f"lorebase_{k.lower()}_{mark}" for k in classes}
    if all(spark.catalog.functionExists(n) for n in names.values()):
        return names
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(text)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    path = f"{shared_dir(spark)}/lorebase/{source.stem}-{mark}.jar"
    fs, where = filesystem(spark, path)
    out = fs.create(where, True)
    out.write(packed.getvalue())
    out.close()
    spark.sql(f"ADD JAR '{path}'")
    for k, kind in classes.items():
        made = compiler.getClassLoader().loadClass(f"lorebase.{source.stem}${k}").newInstance()
        spark._jsparkSession.udf().register(names[k], made, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return names
