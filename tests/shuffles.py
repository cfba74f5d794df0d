"""What a test's queries shuffle."""


def shuffled(spark, run):
    """Bytes that run() shuffles."""

    def total():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before
