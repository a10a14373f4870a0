"""Declared schemas for the corpus data shapes."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
HISTORY = T.ArrayType(MESSAGE)

TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

# R6 run dump
RUN_DUMP = T.StructType([
    T.StructField("profile_id", T.IntegerType()), T.StructField("timestamp_init", T.StringType()),
    T.StructField("timestamp_end", T.StringType()), T.StructField("time_elapsed_seconds", T.DoubleType()),
    T.StructField("turns_max", T.IntegerType()), T.StructField("turns_completed", T.IntegerType()),
    T.StructField("doctor_model", T.StringType()), T.StructField("expand_history", T.BooleanType()),
    T.StructField("stopping_detection", T.BooleanType()), T.StructField("instructions_doctor", T.StringType()),
    T.StructField("instructions_patient", T.StringType()), T.StructField("history_patient", HISTORY),
    T.StructField("history_doctor", HISTORY),
])

# R5 patient profile (the 'conversation' member is dropped on read)
_S = T.StringType()
COGNITIVE_MODEL = T.StructType([T.StructField(n, _S) for n in
                                ("situation", "automatic_thoughts", "emotion", "behavior")])
PROFILE = T.StructType([T.StructField(n, _S) for n in
                        ("name", "age", "gender", "occupation", "marital status", "situation of the client",
                         "counseling history", "resistance toward the support")]
                       + [T.StructField("symptom severity", T.MapType(_S, _S)),
                          T.StructField("cognition distortion exhibition", T.MapType(_S, _S))]
                       + [T.StructField(n, _S) for n in ("depression severity", "suicidal ideation severity",
                                                          "homicidal ideation severity")])
COGNITIVE_PROFILE = T.StructType([T.StructField(n, _S) for n in
                                  ("life_history", "core_beliefs", "core_belief_description",
                                   "intermediate_beliefs", "intermediate_beliefs_during_depression",
                                   "coping_strategies")]
                                 + [T.StructField("cognitive_models", T.ArrayType(COGNITIVE_MODEL))])
PROFILE_ENTRY = T.StructType([T.StructField("profile", PROFILE),
                              T.StructField("cognitive profile", COGNITIVE_PROFILE)])

# R7 score record value
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("explanation", _S),
                      T.StructField("raw", _S)])

# R9 process events
PROCESS_EVENT = T.StructType([T.StructField("process", _S), T.StructField("kind", _S),
                              T.StructField("ts", T.TimestampType())])
