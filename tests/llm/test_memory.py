import ctypes

from reelstat.llm.common import release_memory


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back_to_the_system():
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    size, held = 64_000, []
    for _ in range(2000):
        held.append(libc.malloc(size))
        ctypes.memset(held[-1], 1, size)
    for block in held[:-1]:  # the last one keeps the heap from shrinking by itself
        libc.free(block)
    before = resident()
    release_memory()
    assert before - resident() > 50_000_000
    libc.free(held[-1])
