"""Sensor and actuator conversions of a board, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The board's pins.
OUT_PINS = (2, 4, 5, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22, 23, 25, 26, 27, 32, 33)
IN_PINS = (*OUT_PINS, 34, 35, 36, 39)
ADC_PINS = (32, 33, 34, 35, 36, 39)
DEFAULT_PIN = 2
ECHO_LIMIT_US = 30_000
NO_ECHO = 999


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def truncated(x: Column) -> Column:
    return x.cast("bigint")


def pin(x: Column) -> Column:
    """A whole number from 0 to 39; anything else is pin 2."""
    n = x.try_cast("double")
    return F.when((n == F.floor(n)) & n.between(0, 39), n.cast("int")).otherwise(F.lit(DEFAULT_PIN))


def digital(raw: Column) -> Column:
    return F.when(raw != 0, 1).otherwise(0).cast("bigint")


def analog(raw: Column) -> Column:
    """16 bits to 0..1023."""
    return F.floor(clamp(raw, 0, 65535) / 64).cast("bigint")


def distance_cm(wait_us: Column, pulse_us: Column) -> Column:
    late = (wait_us > ECHO_LIMIT_US) | (pulse_us > ECHO_LIMIT_US)
    return F.when(late, NO_ECHO).otherwise(F.floor(pulse_us / 58)).cast("bigint")


def pwm_duty(percent: Column) -> Column:
    return clamp(truncated(percent), 0, 100) * 655


def servo_ns(angle: Column) -> Column:
    return clamp(truncated(angle), 0, 180) * 10_000 + 500_000


def tone_hz(freq: Column) -> Column:
    return F.greatest(F.lit(1), truncated(freq))


def random_int(low: Column, high: Column, seed: int) -> Column:
    """Both ends included."""
    a, b = truncated(low), truncated(high)
    return (F.floor(F.rand(seed) * (b - a + 1)) + a).cast("bigint")


def chip(name: Column) -> Column:
    """The first match counts, in this order."""
    up = F.upper(name)
    return F.when(up.contains("C3"), "esp32c3").when(up.contains("S3"), "esp32s3").when(up.contains("ESP32"), "esp32")
