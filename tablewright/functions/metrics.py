"""Performance metrics as aggregate expressions of (label, prediction), for any grouping.

Binary labels are positive or negative; 0 and NULL are outside the problem. The sign of a prediction is its
class; what a prediction of exactly 0 counts as is stated where metrics differ. Percentages are out of 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import ratio


def _n(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def table(y: Column, p: Column) -> tuple[Column, Column, Column, Column]:
    """TP, TN, FP, FN: neither class for a prediction of 0."""
    return _n((y > 0) & (p > 0)), _n((y < 0) & (p < 0)), _n((y < 0) & (p > 0)), _n((y > 0) & (p < 0))


def accuracy(y, p):
    """A prediction of 0 is an error."""
    return 100 * F.avg(F.when(y != 0, (F.signum(p) == F.signum(y)).cast("double")))


def tpr(y, p):
    """Over all positives, so that a prediction of 0 misses."""
    return 100 * ratio(_n((y > 0) & (p > 0)), _n(y > 0))


def sensitivity(y, p):
    tp, _, _, fn = table(y, p)
    return 100 * ratio(tp, tp + fn)


def specificity(y, p):
    _, tn, fp, _ = table(y, p)
    return 100 * ratio(tn, tn + fp)


def fpr(y, p):
    return 100 - specificity(y, p)


def ppv(y, p):
    tp, _, fp, _ = table(y, p)
    return F.coalesce(100 * ratio(tp, tp + fp), F.lit(0.0))


def npv(y, p):
    _, tn, _, fn = table(y, p)
    return F.coalesce(100 * ratio(tn, tn + fn), F.lit(0.0))


def mcc(y, p):
    tp, tn, fp, fn = (c.cast("double") for c in table(y, p))
    return F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def bac(y, p):
    """The rate of the one class there is, if there is but one."""
    a, b = sensitivity(y, p), specificity(y, p)
    return F.coalesce((a + b) / 2, a, b)


def bac2(y, p):
    a, b = sensitivity(y, p), specificity(y, p)
    return F.coalesce(a * b / 100, a, b)


def fscore(y, p, beta: float = 1.0):
    tp, _, fp, fn = table(y, p)
    return F.coalesce(100 * ratio((1 + beta**2) * tp, (1 + beta**2) * tp + beta**2 * fn + fp), F.lit(0.0))


def gmean(y, p):
    """Not a percentage."""
    return F.sqrt(sensitivity(y, p) * specificity(y, p)) / 100


def psi(y, p):
    return ppv(y, p) + npv(y, p) - 100


def nnp(y, p):
    return F.coalesce(F.abs(ratio(F.lit(100.0), psi(y, p))), F.lit(0.0))


def plr(y, p):
    return F.coalesce(ratio(sensitivity(y, p), 100 - specificity(y, p)), F.lit(0.0))


def nlr(y, p):
    """Specificity over 1 - sensitivity, as the criterion list has it; `nlr_usual` is the common form."""
    return F.coalesce(ratio(specificity(y, p), 100 - sensitivity(y, p)), F.lit(0.0))


def nlr_usual(y, p):
    return F.coalesce(ratio(100 - sensitivity(y, p), specificity(y, p)), F.lit(0.0))


def dor(y, p):
    a, b = sensitivity(y, p), specificity(y, p)
    return ratio(a * b, (100 - a) * (100 - b))


def youden(y, p):
    return (sensitivity(y, p) + specificity(y, p)) / 100 - 1


def kappa(y, p):
    tp, tn, fp, fn = (c.cast("double") for c in table(y, p))
    n = tp + tn + fp + fn
    by_chance = ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n * n)
    return ratio((tp + tn) / n - by_chance, 1 - by_chance)


def brier(y, p):
    """y in 0, 1; p a probability."""
    return F.avg(F.pow(p - y, 2))


def mse(y, p):
    return F.avg(F.pow(p - y, 2))


def mae(y, p):
    return F.avg(F.abs(p - y))


def mae_sd(y, p):
    return F.stddev_samp(F.abs(p - y))


def rmsd(y, p):
    return F.sqrt(mse(y, p))


def nrmsd(y, p):
    return 100 * ratio(F.sqrt(mse(y, p)), F.max(y) - F.min(y))


def nrsmd(y, p):
    return 100 * F.sqrt(ratio(F.sum(F.pow(p - y, 2)), F.sum(y * y)))


def cc(y, p):
    """0 for a constant prediction."""
    return F.when(F.min(p) == F.max(p), 0.0).otherwise(F.corr(y, p))


def scc(y, p):
    return 100 * F.pow(cc(y, p), 2)


def net_benefit(y, p, threshold: float):
    """y > 0 marks a case, p is a probability; treated from threshold on."""
    n = F.count(F.when(y.isNotNull() & p.isNotNull(), 1))
    return _n((y > 0) & (p >= threshold)) / n - _n((y <= 0) & (p >= threshold)) / n * (threshold / (1 - threshold))


BINARY: dict[str, Callable] = {f.__name__: f for f in (accuracy, tpr, sensitivity, specificity, fpr, ppv, npv, mcc, bac, bac2, fscore, gmean, psi, nnp, plr, nlr, nlr_usual, dor, youden, kappa)}
REGRESSION: dict[str, Callable] = {f.__name__: f for f in (mse, mae, mae_sd, rmsd, nrmsd, nrsmd, cc, scc)}
#: Criteria that are best when small; all others when large.
SMALLER_IS_BETTER = frozenset({"fpr", "nlr_usual", "mse", "mae", "mae_sd", "rmsd", "nrmsd", "nrsmd", "brier", "ece", "mce"})


def direction(name: str) -> str:
    return "min" if name in SMALLER_IS_BETTER else "max"
