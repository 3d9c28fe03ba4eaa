"""The driver's memory."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def ease(spark: SparkSession) -> str:
    """Give back driver memory that lies unused; what the JVM says of it, or nothing if its kind cannot.

    Each plan is compiled: glibc keeps what the compilers have freed, and a heap that
    planning has grown stays large until it is collected.
    """
    sc = spark.sparkContext
    lang, gateway = sc._jvm.java.lang, sc._gateway
    heap = lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        lang.System.gc()
    # By the interface's method: the class of the server itself is not open to Py4J.
    kinds, given = gateway.new_array(lang.Class, 4), gateway.new_array(lang.Object, 4)
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    for i, name in enumerate(names):
        kinds[i] = lang.Class.forName(name)
    given[0], given[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # another JVM or C library
        return ""
