import os

# tests call numeric code in the driver, beside a JVM; workers get one thread from Spark
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
