"""What a session has written to shuffles so far."""


def shuffled(spark):
    """Bytes and rows."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in each), sum(s.shuffleWriteRecords() for s in each)
